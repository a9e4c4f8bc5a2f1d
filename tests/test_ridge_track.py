"""Ridge on all features: coefficients, validation and choice, test scores, against numpy and pandas on the smallest tables."""

import numpy as np
import pytest

from tidepanel.plans import registry


def test_ridge_track_against_numpy(spark, small, monkeypatch):
    rows = registry._wide_rows(spark, small)
    monkeypatch.setattr(registry, "_wide_rows", lambda s, d: rows)  # the same stored rows for all three queries
    table = rows.toPandas()
    coefficients = registry.ridge_coefficients(spark, small).toPandas()
    validation = registry.ridge_validation(spark, small).toPandas()
    scores = registry.ridge_test(spark, small).toPandas()
    chosen = {}
    for fold, own in table.groupby("fold"):
        train = own[own.role == "train"]
        x, y = train[registry.ALL].to_numpy(float), train.y.to_numpy(float)
        n = train.groupby("signal_date").y.transform("size")
        w = (1 / n / (1 / n).mean()).to_numpy()
        assert np.allclose(train.assign(w=w).groupby("signal_date").w.sum(), len(train) / train.signal_date.nunique())
        xc, yc = x - (w @ x) / w.sum(), y - (w @ y) / w.sum()
        check = own[own.role == "validation"]
        found = []
        for alpha in (0.1, 1.0, 10.0, 100.0):
            beta = np.linalg.solve(xc.T @ (xc * w[:, None]) + alpha * np.eye(x.shape[1]), xc.T @ (w * yc))
            intercept = (w @ y) / w.sum() - (w @ x) / w.sum() @ beta
            got = coefficients[(coefficients.fold == fold) & (coefficients.alpha == alpha)].set_index("feature").coefficient
            assert len(got) == 159
            assert np.allclose(got[registry.ALL], beta, atol=1e-6 * max(1, abs(beta).max())) and got["__intercept__"] == pytest.approx(intercept, rel=1e-6, abs=1e-6)
            score = check.assign(score=check[registry.ALL].to_numpy(float) @ beta + intercept)
            ics = score.groupby("signal_date").apply(lambda g: g.score.rank().corr(g.y.rank()) if g.score.nunique() > 1 and g.y.nunique() > 1 else np.nan, include_groups=False).dropna()
            mine = validation[(validation.fold == fold) & (validation.alpha == alpha)].iloc[0]
            assert (mine.n, mine.mean_rank_ic, mine.rank_icir) == (len(ics), pytest.approx(ics.mean(), abs=1e-6), pytest.approx(ics.mean() / ics.std(), rel=1e-4, abs=1e-5))
            found.append((ics.mean(), ics.mean() / ics.std(), alpha, beta, intercept))
        chosen[fold] = max(found, key=lambda f: f[:3])
    for fold, own in scores.groupby("fold"):
        _, _, alpha, beta, intercept = chosen[fold]
        test = table[(table.fold == fold) & (table.role == "test")].set_index(["signal_date", "security_id"])
        assert set(own.alpha) == {alpha} and len(own) == len(test)
        want = test[registry.ALL].to_numpy(float) @ beta + intercept
        got = own.set_index(["signal_date", "security_id"]).score.reindex(test.index)
        assert np.allclose(got, want, rtol=1e-4, atol=1e-5)
        assert own.groupby("signal_date").neutral_score.sum().abs().max() < 1e-4  # a residual on dummies sums to nothing
