"""Boosting goes on to its usual number of rounds; folds that a task boosts by itself and folds grown in passes have the same trees."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_trees import FEATURES, panel

from tidepanel.operators import trees
from tidepanel.plans import tree_track


def test_registered_queries_take_the_usual_rounds():
    """F8 to F13: 6 rounds with a patience of 3 left little of the work."""
    assert (tree_track.ROUNDS, tree_track.PATIENCE) == (2000, 100)


def rounded(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=str)


def test_a_task_or_passes_give_the_same_trees(spark, monkeypatch):
    two = panel(spark).unionByName(panel(spark, n_dates=8, seed=8).withColumn("fold", F.lit("b")))
    grid = [{"num_leaves": n, "learning_rate": 0.2, "min_data_in_leaf": m, "bagging_fraction": 0.8, "feature_fraction": 0.8} for n in (3, 9) for m in (1, 8)] + [{"max_depth": 2, "lambda_l1": 0.3}, {"max_depth": 0}]
    cuts = trees.normal_cuts(5, 16)
    get = lambda: trees.fit(two, FEATURES, grid, cuts, 5, 2)
    held = get()
    monkeypatch.setattr(trees, "COPIED", 0)
    few = get()
    monkeypatch.setattr(trees, "HELD", 15 * 5 * 24)  # a is grown in passes, b by tasks
    some = get()
    monkeypatch.setattr(trees, "HELD", 0)
    passes = get()
    for other in (few, some, passes):
        assert rounded(other.trees) == rounded(held.trees) and rounded(other.rounds) == rounded(held.rounds)
    assert held.trees.dtypes == passes.trees.dtypes and held.rounds.dtypes == passes.rounds.dtypes
    assert {(r.fold, r.candidate_id) for r in held.rounds.collect()} == {(f, k) for f in "ab" for k in range(6)}


@pytest.mark.parametrize("n_features", [1, 6, 7])
@pytest.mark.parametrize(("rows", "weight"), [(60, 1.5), (3000, 1.5), (3000, 1e6)])
def test_sums_of_pairs_of_features_are_whole(n_features, rows, weight):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 8, (9, 4000)).astype(np.uint8)
    own, columns = np.sort(rng.choice(4000, rows, replace=False)), np.sort(rng.choice(9, n_features, replace=False))
    g, h = np.rint(rng.normal(size=4000) * trees.SCALE), np.rint(rng.random(4000) * weight * trees.SCALE)
    got = trees._leaf_sums(trees._pairs(x, columns, 8), own, n_features, 8, g, h)
    for k, f in enumerate(columns):
        for b in range(8):
            at = own[x[f, own] == b]
            assert got[:, k, b].tolist() == [g[at].sum(), h[at].sum(), len(at)]


def test_ranks_of_a_day_are_those_of_spark(spark):
    rng = np.random.default_rng(1)
    day, score, y = np.sort(rng.integers(0, 5, 90)), rng.integers(0, 6, 90).astype(float), rng.integers(0, 40, 90).astype(float)
    score[day == 2] = 1.0
    table = spark.createDataFrame([(int(d), float(s), float(v)) for d, s, v in zip(day, score, y, strict=True)], "day int, score double, y double").withColumn("fold", F.lit("a"))
    want = trees.ic_statistics(trees.rank_ic(table, "score", "y", "day", "fold"), "rank_ic", ["fold"]).first()
    assert trees._statistics(day, score, trees._places(day, y)) == (4, *(pytest.approx(want[c], abs=1e-12) for c in ("mean", "std", "icir", "positive_ratio")))
    assert trees._statistics(day[:0], score[:0], y[:0]) == trees._statistics(day[:3], score[:3] * 0, y[:3]) == (0, None, None, None, None)
