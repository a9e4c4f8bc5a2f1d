"""Leaf-wise boosted trees against a plain greedy version, with stopping, candidates, refits and split counts."""

import datetime

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidepanel.operators import models, trees
from tidepanel.operators.contracts import ContractError

FEATURES = [f"f{k}" for k in range(5)]


def panel(spark, n_dates=12, names=24, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for d in range(n_dates):
        for i in range(names):
            x = rng.normal(size=5)
            x[4] = round(x[4])
            y = 0.5 * x[0] + (x[1] > 0) * x[2] + 0.3 * rng.normal()
            role = ["train", "train", "validation", "test"][d * 4 // n_dates]
            day = datetime.date(2020, 1, 1) + datetime.timedelta(days=7 * d)
            rows.append(("a", role, day, f"s{i:02d}", float(y), float(1 + i % 3), *(float(v) if rng.random() > 0.03 else None for v in x), "clash"))
    return spark.createDataFrame(rows, "fold string, role string, signal_date date, security_id string, y double, w double, " + ", ".join(f"{f} double" for f in FEATURES) + ", score string")


def bins_of(rows, cuts):
    return np.array([[0 if r[f] is None else int((cuts[k] < r[f]).sum()) for k, f in enumerate(FEATURES)] for r in rows])


def greedy(x, g, h, c, seen):
    """Leaves as boolean masks, the one of largest gain split first: list of (mask, value) and the splits in order."""
    def find(mask):
        def strength(m):
            gs, hs = g[m].sum() / trees.SCALE, h[m].sum() / trees.SCALE
            return np.sign(gs) * max(abs(gs) - c["lambda_l1"], 0), hs + c["lambda_l2"]

        top, all_g, all_h = None, *strength(mask)
        for f in seen:
            for b in range(7):
                low, high = mask & (x[:, f] <= b), mask & (x[:, f] > b)
                if min(low.sum(), high.sum()) < max(1, c["min_data_in_leaf"]):
                    continue
                (lg, lh), (hg, hh) = strength(low), strength(high)
                gain = lg * lg / lh + hg * hg / hh - all_g * all_g / all_h
                if gain > 1e-12 and (top is None or gain > top[0] + 1e-13):
                    top = (gain, int(f), b, low, high)
        return top

    leaves, order = [(np.ones(len(x), bool), 0)], []
    while len(leaves) < c["num_leaves"]:
        options = [(find(m), k) for k, (m, depth) in enumerate(leaves) if c["max_depth"] < 0 or depth < c["max_depth"]]
        options = [(t, k) for t, k in options if t]
        if not options:
            break
        t, k = max(options, key=lambda o: o[0][0])
        depth = leaves.pop(k)[1] + 1
        leaves += [(t[3], depth), (t[4], depth)]
        order.append((t[1], t[2], t[0]))
    value = lambda m: -c["learning_rate"] * np.sign(g[m].sum()) * max(abs(g[m].sum() / trees.SCALE) - c["lambda_l1"], 0) / (h[m].sum() / trees.SCALE + c["lambda_l2"])
    return [(m, value(m)) for m, _ in leaves], order


@pytest.mark.parametrize("c", [
    {"num_leaves": 6, "learning_rate": 0.3, "min_data_in_leaf": 5, "lambda_l2": 1.0},
    {"num_leaves": 20, "learning_rate": 0.2, "min_data_in_leaf": 2, "lambda_l1": 0.5, "lambda_l2": 0.0, "max_depth": 3},
    {"num_leaves": 4, "learning_rate": 0.5, "min_data_in_leaf": 9, "bagging_fraction": 0.7, "feature_fraction": 0.5, "seed": 4},
])
def test_trees_are_grown_leaf_by_leaf(spark, c):
    table = panel(spark).repartition(5)
    cuts = trees.normal_cuts(5, 8)
    fitted = trees.fit(table, FEATURES, [c, c | {"num_leaves": 3}], cuts, rounds=3, patience=4)
    nodes = fitted.trees.collect()
    c = trees.DEFAULTS | c
    rows = table.where("role = 'train'").withColumn("u", F.xxhash64("signal_date", "security_id")).collect()
    x, y, w = bins_of(rows, cuts), np.array([r.y for r in rows]), np.array([r.w for r in rows])
    u = np.array([r.u for r in rows], np.int64)
    score = np.full(len(rows), round(float((y * w).sum() / w.sum()), 12))
    assert [r.value for r in nodes if r.iteration == 0 and r.candidate_id == 0] == [pytest.approx(score[0], abs=1e-11)]
    for it in range(1, 4):
        bag, seen = trees.seen_rows(u, c, it), trees.seen_features(5, c, it)
        assert len(seen) == int(np.ceil(5 * c["feature_fraction"]))
        g, h = np.rint(w * (score - y) * trees.SCALE) * bag, np.rint(w * trees.SCALE) * bag
        leaves, order = greedy(x[bag], g[bag], h[bag], c, seen)
        own = [r for r in nodes if r.iteration == it and r.candidate_id == 0]
        got = sorted((r.feature, r.bin, round(r.gain, 8)) for r in own if r.feature)
        assert got == sorted((f"f{f}", b, round(gain, 8)) for f, b, gain in order)
        assert sum(r.feature is None for r in own) == len(leaves) == len(order) + 1
        tree = trees._tree(sorted(own, key=lambda r: r.node), {f: k for k, f in enumerate(FEATURES)})
        moved = tree.value[tree.leaf_of(x)]
        for m, v in leaves:
            assert np.allclose(moved[bag][m], v, atol=1e-9)
        assert all(tree.rows[k] == (tree.leaf_of(x[bag]) == k).sum() for k in range(len(own)) if tree.feature[k] < 0)
        score = score + moved
    assert {r.candidate_id for r in nodes} == {0, 1}


@pytest.mark.parametrize("weight", [1.5, 1e6])
def test_histograms_are_whole_sums(weight):
    rng = np.random.default_rng(5)
    x, leaf = rng.integers(0, 8, (4, 3000)).astype(np.uint8), rng.integers(0, 3, 3000)
    g, h = np.rint(rng.normal(size=3000) * trees.SCALE), np.rint(rng.random(3000) * weight * trees.SCALE)
    got = trees._added(x, leaf, 3, 8, g, h)
    assert got.shape == (3, 4, 3, 8)
    for f in range(4):
        for n in range(3):
            for b in range(8):
                own = (leaf == n) & (x[f] == b)
                assert got[:, f, n, b].tolist() == [g[own].sum(), h[own].sum(), own.sum()]


def test_one_partition_or_many_give_the_same_trees(spark):
    table, cuts, c = panel(spark), trees.normal_cuts(5, 16), [{"num_leaves": 5, "bagging_fraction": 0.8, "feature_fraction": 0.8}]
    get = lambda t: sorted(map(tuple, trees.fit(t, FEATURES, c, cuts, 3, 3).trees.collect()), key=str)
    assert get(table.coalesce(1)) == get(table.repartition(9, "security_id"))


def test_patience_choice_and_refit(spark):
    two = panel(spark).unionByName(panel(spark, seed=8).withColumn("fold", F.lit("b")))
    cuts = trees.quantile_cuts(two.where("role = 'train'"), FEATURES, 16)
    assert cuts.shape == (5, 15) and (np.diff(cuts, axis=1) >= 0).all()
    grid = [{"num_leaves": n, "learning_rate": r, "min_data_in_leaf": 8} for n in (2, 6) for r in (0.05, 1.0)]
    fitted = trees.fit(two, FEATURES, grid, cuts, rounds=7, patience=2)
    by = {}
    for r in fitted.rounds.collect():
        by.setdefault((r.fold, r.candidate_id), {})[r.iteration] = r.mean_rank_ic
    assert set(by) == {(f, k) for f in "ab" for k in range(4)}
    best = {(r.fold, r.candidate_id): r.best_iteration for r in trees.best_rounds(fitted.rounds).collect()}
    stopped = 0
    for m, ics in by.items():
        assert sorted(ics) == list(range(1, len(ics) + 1))
        assert best[m] == max(ics, key=lambda k: (ics[k], -k))
        assert len(ics) == min(7, best[m] + 2)
        stopped += len(ics) < 7
    assert stopped
    made = trees.best_rounds(fitted.rounds).join(models.candidate_grid(spark, {"num_leaves": [2, 6], "learning_rate": [0.05, 1.0], "min_data_in_leaf": [8], "lambda_l2": [0.0]}), "candidate_id")
    chosen = models.best_tree_candidates(made).collect()
    assert len(chosen) == 2
    pick = spark.createDataFrame([(r.fold, r.candidate_id, r.best_iteration) for r in chosen], "fold string, candidate_id int, best_iteration int")
    kept = trees.upto(fitted.trees, pick)
    scored = {(r.fold, r.signal_date, r.security_id): r.score for r in trees.predict(two.where("role = 'test'").drop("score"), kept, FEATURES, cuts).collect()}
    assert len(scored) == 2 * 3 * 24
    for r in chosen:  # fitting the chosen parameters anew for that many rounds gives the same trees
        again = trees.fit(two.where(F.col("fold") == r.fold).where("role = 'train'"), FEATURES, [grid[r.candidate_id]], cuts, r.best_iteration, 99)
        same = lambda df: sorted(((x.iteration, x.node, x.feature, x.bin, x.value) for x in df.collect()), key=str)
        assert same(again.trees) == same(kept.where(F.col("fold") == r.fold))
    shares = trees.importances(kept, FEATURES).collect()
    assert len(shares) == 10
    nodes = kept.collect()
    for r in shares:
        own = [x.gain for x in nodes if x.fold == r.fold and x.feature == r.feature]
        assert (r.split_importance, r.gain_importance) == (len(own), pytest.approx(sum(own)))
    with pytest.raises(ContractError, match="more than one candidate"):
        trees.predict(two.drop("score"), fitted.trees, FEATURES, cuts)


def test_trees_of_odd_tables(spark):
    table, cuts = panel(spark), trees.normal_cuts(5, 8)
    none = trees.fit(table.limit(0), FEATURES, [{}], cuts, 2, 2)
    assert none.trees.count() == none.rounds.count() == 0
    flat = trees.fit(table.withColumn("y", F.lit(1.0)), FEATURES, [{"min_data_in_leaf": 1}], cuts, 3, 2)
    assert [(r.node, r.feature) for r in flat.trees.where("iteration = 1").collect()] == [(0, None)]
    assert [r.mean_rank_ic for r in flat.rounds.collect()] == [None, None]
    holes = table.unionByName(table.withColumns({"y": F.lit(float("nan")), "security_id": F.lit("z")})).unionByName(table.withColumns({"w": F.lit(None).cast("double"), "security_id": F.lit("y")}))
    get = lambda t: sorted(map(tuple, trees.fit(t, FEATURES, [{"num_leaves": 4}], cuts, 2, 2).trees.collect()), key=str)
    assert get(holes) == get(table)
    assert trees.predict(table.drop("score"), none.trees, FEATURES, cuts).where("score is null").count() == table.count()
    for bad in ([{"leaves": 3}], []):
        with pytest.raises(ContractError):
            trees.fit(table, FEATURES, bad, cuts, 2, 2)


def test_rows_are_kept_in_blocks():
    """Rows of one (fold, chunk, role) lie together, whatever batches they come in; none is lost, and an unknown date stays one."""
    rng = np.random.default_rng(2)
    n, features = 40_000, 3
    x, fold, role, chunk = rng.integers(0, 9, (n, features)).astype(np.uint8), rng.choice(["a", "b"], n, p=[0.9, 0.1]), rng.integers(0, 2, n), rng.integers(0, 2, n)
    u, y, w, day = np.arange(n), rng.normal(size=n), rng.random(n), np.where(np.arange(n) % 50 == 0, -(2**31), rng.integers(0, 9, n)).astype(np.int32)
    table = pa.table({"fold": fold, "chunk": pa.array(chunk, pa.int32()), "role": pa.array(role, pa.int32()), "day": day, "u": u, "y": y, "w": w}).append_column("x", [trees._bytes(x)])
    made = list(trees._packed_blocks(features, {"a": 0.5, "b": -1.0}, 2, 3)(iter(table.to_batches(max_chunksize=700))))
    assert max(b.column("n")[0].as_py() for b in made) == trees.BLOCK and len(made) <= 20
    seen = []
    for batch in made:
        (key, own), = trees._blocks(batch, features)
        at = own["u"]
        seen += at.tolist()
        assert (fold[at] == key[0]).all() and (chunk[at] == key[1]).all() and (role[at] == batch.column("role")[0].as_py()).all()
        assert (own["x"].T == x[at]).all() and (own["y"] == y[at]).all() and (own["w"] == w[at]).all() and (own["day"] == day[at]).all()
        assert own["scores"].shape == (2 - key[1], len(at)) and (own["scores"] == (0.5 if key[0] == "a" else -1.0)).all()
    assert sorted(seen) == list(range(n))
    assert list(trees._packed_blocks(features, {}, 2, 3)(iter([]))) == []
