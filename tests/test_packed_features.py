"""Features as one column of bytes are the same numbers as features in columns, and so is their cleaning."""

import numpy as np
from pyspark.sql import functions as F

from tidepanel.operators import cross_section, models, rolling, trees, wide
from tidepanel.plans import registry


def matrix(df):
    rows = df.orderBy("trade_date", "security_id").collect()
    names = rolling.feature_names()
    return np.array([np.frombuffer(r.x) if "x" in r else [np.nan if r[n] is None else r[n] for n in names] for r in rows])


def test_packed_features_and_their_cleaning(spark, small):
    p = registry.P(spark, small).where(F.col("security_id") < 7)
    names = rolling.feature_names()
    columns, packed = rolling.all_features(p).localCheckpoint(), rolling.all_features(p, packed=True).localCheckpoint()
    assert packed.columns == ["trade_date", "security_id", "x"]
    assert np.array_equal(matrix(columns), matrix(packed), equal_nan=True) and np.isnan(matrix(packed)).any()
    clean = matrix(cross_section.preprocess(columns, names))
    assert np.allclose(matrix(wide.preprocess(packed, names, "trade_date")), clean, atol=1e-9)
    cuts = trees.normal_cuts(len(names))
    binned = wide.preprocess(packed, names, "trade_date", lambda z: trees.bins_of(z, cuts)).orderBy("trade_date", "security_id").collect()
    assert np.array_equal([np.frombuffer(r.x, np.uint8) for r in binned], trees.bins_of(matrix(wide.preprocess(packed, names, "trade_date")), cuts))
    assert trees.bins_of(np.array([[np.nan, 0.0], [-9.0, 9.0]]), cuts[:2]).tolist() == [[0, 15], [0, 31]]
    assert wide.preprocess(packed.limit(0), names, "trade_date").count() == 0


def test_linear_models_read_an_array_of_features(spark):
    """Rows with the features as an array have the coefficients and scores of rows with columns; those with a NULL are left out or have no score."""
    rng = np.random.default_rng(4)
    x, names = rng.normal(size=(90, 3)), ["a", "b", "c"]
    rows = [("f" if k % 2 else "g", float(w), float(y), *map(float, v)) for k, (w, y, v) in enumerate(zip(rng.uniform(0.5, 1.5, 90), rng.normal(size=90), x, strict=True))]
    rows += [("f", 1.0, 1.0, 2.0, None, 1.0), ("g", None, 1.0, 1.0, 1.0, 1.0), ("f", 1.0, None, 1.0, 1.0, 1.0), rows[3], rows[3]]
    columns = spark.createDataFrame(rows, "fold string, w double, y double, a double, b double, c double").repartition(3)
    listed = columns.select("fold", "w", "y", F.array(*names).alias("x"))
    made = [{tuple(r[:3]): r[3] for r in models.ridge(t, names, "y", "w", (1.0, 5.0)).collect()} for t in (columns, listed)]
    assert made[0].keys() == made[1].keys() and len(made[0]) == 2 * 2 * 4
    assert np.allclose([made[0][k] for k in made[0]], [made[1][k] for k in made[0]])
    coefficients = models.ridge(columns, names, "y", "w", (1.0, 5.0))
    for t in (columns, listed):
        got = models.predict_linear(t.withColumn("key", F.monotonically_increasing_id()), coefficients, names)
        assert got.columns == ["fold", "w", "y", "key", "alpha", "score"]
        got = got.collect()
        assert len(got) == 2 * len(rows) and sum(r.score is None for r in got) == 2
        assert len({(r.alpha, r.score) for r in got if (r.fold, r.w, r.y) == rows[3][:3]}) == 2  # equal rows have equal scores
        want = lambda r, v: made[0][r.fold, r.alpha, "__intercept__"] + sum(made[0][r.fold, r.alpha, n] * z for n, z in zip(names, v, strict=True))
        values = {(r[0], r[1], r[2]): r[3:] for r in rows}
        assert all(r.score is None or abs(r.score - want(r, values[r.fold, r.w, r.y])) < 1e-9 for r in got)


def test_fold_features_go_as_one_array(spark, small):
    """The ridge queries read the array; the columns beside it are not made."""
    rows = registry._wide_rows(spark, small)
    assert set(registry.ALL) <= set(rows.columns) and dict(rows.dtypes)["x"] == "array<double>"
    plan = rows.where("role = 'test'").select("fold", "x")._jdf.queryExecution().executedPlan().toString()
    assert "kmid" not in plan and "vsumd60" not in plan
