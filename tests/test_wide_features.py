"""Rolling sums in Arrow batches against each frame taken on its own, and the shape of the wide plans."""

import datetime as dt

import numpy as np
import pyarrow as pa
import pytest

from tidepanel.operators import cross_section, rolling, wide
from tidepanel.plans import registry


def _series(rng, n):
    x = {c: rng.normal(5, 1, n) for c in rolling.BASE}
    x["close"][3:9] = 2.5  # a constant stretch
    for c in ("close", "lv", "cr", "v", "dc"):
        x[c] = np.where(rng.random(n) < 0.15, np.nan, x[c])
    return x


def _alone(x, t, d):
    """Features of the frame that ends at t, by definition."""
    own = {c: v[max(0, t - d + 1) : t + 1] for c, v in x.items()}
    c, c0, out = own["close"], x["close"][t], {}
    known, place = c[~np.isnan(c)], np.arange(len(c))[~np.isnan(c)]
    out["ma"] = known.mean() / c0 if len(known) else np.nan
    out["std"] = known.std(ddof=1) / c0 if len(known) > 1 else np.nan
    if len(known) > 1:
        slope, level = np.polyfit(place, known, 1)
        out["beta"], out["resi"] = slope / c0, (c0 - level - slope * (len(c) - 1)) / c0
    both = ~np.isnan(c) & ~np.isnan(own["lv"])
    a, b = c[both], own["lv"][both]
    out["corr"] = np.corrcoef(a, b)[0, 1] if len(a) > 1 and a.std() > 0 and b.std() > 0 else np.nan
    dc = own["dc"][~np.isnan(own["dc"])]
    out["sumd"] = dc.sum() / (np.abs(dc).sum() + 1e-12) if len(dc) else np.nan
    out["roc"] = x["close"][t - d] / c0 if t >= d else np.nan
    out["cntp"] = own["up"].mean()
    out["max"] = own["high"].max() / c0
    return out


@pytest.mark.parametrize("size", [1, 7, 500])
def test_frames_do_not_depend_on_batches_or_neighbours(size):
    rng = np.random.default_rng(3)
    parts = [_series(rng, n) for n in (40, 1, 90, 12)]
    rows = {c: np.concatenate([p[c] for p in parts]) for c in rolling.BASE}
    rows["rn"] = np.concatenate([np.arange(1.0, len(p["close"]) + 1) for p in parts])
    table = pa.RecordBatch.from_arrays([pa.array(v, from_pandas=True) for v in rows.values()], names=list(rows))
    families, windows = ["ma", "std", "beta", "resi", "corr", "sumd", "roc", "cntp", "max", "qtlu"], (5, 20)
    names = [f"{f}{d}" for f in families for d in windows]
    got = pa.Table.from_batches(rolling._rolled(families, windows, names)(table.slice(k, size) for k in range(0, table.num_rows, size)))
    want = [{f"{f}{d}": v for d in windows for f, v in _alone(p, t, d).items()} for p in parts for t in range(len(p["close"]))]
    for n in names:
        if not n.startswith("qtlu"):
            found = np.array([np.nan if v is None else v for v in got.column(n).to_pylist()])
            np.testing.assert_allclose(found, [w.get(n, np.nan) for w in want], rtol=1e-9, atol=1e-12, err_msg=n)


def test_no_window_sums_its_frames_anew(spark):
    """What a row costs must not grow with 125 rows a column of five windows."""
    day = dt.date(2024, 1, 1)
    rows = [(day + dt.timedelta(k), "s", 1.0, 2.0, 0.5, 1.5, 1.2, 10.0) for k in range(3)]
    p = spark.createDataFrame(rows, "trade_date date, security_id string, adjusted_open double, adjusted_high double, adjusted_low double, adjusted_close double, vwap double, volume double")
    plan = rolling.all_features(p)._jdf.queryExecution().executedPlan().toString()
    assert "regr" not in plan and "covar_pop" not in plan and "specifiedwindowframe(RowFrame, -" not in plan.replace("-1, -1", "")


def _cleaning_rows(spark, n, k):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(n, k)) * 10.0 ** rng.integers(-2, 3, k)
    x[:, 1], x[:, 2] = np.round(x[:, 1] / np.abs(x[:, 1]).max() * 2), 7.0  # ties, and no variance
    x[: n // 2, 3] = np.nan  # no value on the first date
    x[rng.random((n, k)) < 0.05] = np.nan
    x[5, 4], x[6, 4] = np.inf, -np.inf
    rows = [(dt.date(2024, 1, 1 + (i >= n // 2)), str(i), *(None if np.isnan(v) else float(v) for v in row)) for i, row in enumerate(x)]
    names = [f"f{j}" for j in range(k)]
    return names, spark.createDataFrame(rows, f"trade_date date, security_id string, {', '.join(f'{c} double' for c in names)}").repartition(5, "security_id")


def test_a_date_is_cleaned_without_bringing_its_rows_together(spark, monkeypatch):
    monkeypatch.setattr(wide, "DRAWN", 60)  # brackets that hold a part of the rows
    names, p = _cleaning_rows(spark, 800, 30)
    many = cross_section.preprocess(p, names)
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and "trade_date" not in "".join(line for line in plan.splitlines() if "hashpartitioning" in line)
    got = {r.security_id: r for r in many.collect()}
    for part in (names[:15], names[15:]):
        for r in cross_section.preprocess(p, part).collect():
            assert [got[r.security_id][c] for c in part] == pytest.approx([r[c] for c in part], abs=1e-9)


def test_a_bracket_that_misses_its_median_is_opened(spark, monkeypatch):
    names, p = _cleaning_rows(spark, 120, 26)
    asked = []

    def astray(shared, names, date):
        asked.append(1)
        return lambda rows: pa.table({"at": pa.array([shared.value.dates[rows.column(date)[0].as_py()]], pa.int64()), "low": [np.full(len(names), 1e9).tobytes()], "high": [np.full(len(names), 2e9).tobytes()]})

    want = {(r.trade_date, r.security_id): r for r in cross_section.preprocess(p, names).collect()}
    monkeypatch.setattr(wide, "_brackets", astray)
    got = cross_section.preprocess(p, names).collect()
    assert asked and all(list(r)[2:] == pytest.approx(list(want[r.trade_date, r.security_id])[2:], abs=1e-12) for r in got)


def test_quality_of_many_features_equals_that_of_few(spark):
    names, p = _cleaning_rows(spark, 400, 30)
    few = [r for part in (names[:15], names[15:]) for r in cross_section.quality(p, part).collect()]
    found = cross_section.quality(p, names)
    got = {(r.trade_date, r.feature): r for r in found.collect()}
    assert len(got) == len(few) == 60 and "Window" not in found._jdf.queryExecution().executedPlan().toString()
    for r in few:
        own = got[r.trade_date, r.feature].asDict()
        for c, v in r.asDict().items():
            assert own[c] == (pytest.approx(v, abs=1e-9) if isinstance(v, float) else v), (r.feature, c)
    assert cross_section.preprocess(p.limit(0), names).count() == 0 and cross_section.quality(p.limit(0), names).count() == 0


def test_wide_fold_rows_are_neither_joined_nor_shuffled(spark, small):
    plan = registry._wide_rows(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and plan.count("FileScan parquet") == 1
