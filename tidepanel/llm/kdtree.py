"""Operator 1: exact top-k inner products with a KD-tree per shard.

Distinct vectors are dealt over shards by space: the top splits of a KD-tree, fitted on a
bounded sample, send each vector to a cell; a cell with too many vectors is dealt on by
hash.  Each shard becomes one tree of median splits with tight bounding boxes, built and
stored once.  Up to ``GROUP`` shards of neighbouring cells form a group.  A query first
searches the group with the shard whose box allows the largest product, and its kth score
there is handed on as a bound: only groups with a shard whose box can reach it see the
query, one row each with a bit per shard.  In a group shards are walked in the order of
their boxes' bounds, each taking over the kth score of those before; inside a tree, nodes
are visited best first, and the kth best score so far ends the search.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.llm.store import written

LEAF = 256
#: Bytes of boxes that are broadcast at once, and of vectors in one tree.
BOX_BYTES, TREE_BYTES = 32 << 20, 4 << 20
#: Neighbouring cells, and parts of a cell, whose shards form a group; a group has at most their product.
GROUP_CELLS, GROUP_PARTS = 8, 2
GROUP = GROUP_CELLS * GROUP_PARTS


@dataclass
class Tree:
    """Points in leaf order; ``ids[at[p]:at[p + 1]]`` hold point p; a node covers ``span`` points inside ``low``..``high``."""

    points: np.ndarray
    ids: np.ndarray
    at: np.ndarray
    low: np.ndarray
    high: np.ndarray
    left: np.ndarray
    right: np.ndarray
    span: np.ndarray

    def packed(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.__dict__)
        return out.getvalue()

    @staticmethod
    def unpacked(data: bytes) -> Tree:
        with np.load(io.BytesIO(data)) as found:
            return Tree(**{name: found[name] for name in found.files})


def build(vectors: np.ndarray, ids: np.ndarray) -> Tree:
    """A tree over the distinct vectors, with all ids of each, ascending."""
    order = np.lexsort((ids, *vectors.T[::-1])) if vectors.shape[1] else np.argsort(ids, kind="stable")
    vectors, ids = vectors[order], ids[order]
    fresh = np.ones(len(vectors), bool)
    fresh[1:] = (vectors[1:] != vectors[:-1]).any(1)
    starts = np.flatnonzero(fresh)
    points, ends = vectors[starts], np.append(starts[1:], len(ids))
    perm = np.arange(len(points))
    low, high, left, right, span = [], [], [], [], []

    def grow(a: int, b: int) -> int:
        own = points[perm[a:b]]
        node = len(low)
        low.append(own.min(0))
        high.append(own.max(0))
        left.append(-1)
        right.append(-1)
        span.append((a, b))
        if b - a > LEAF:
            axis = int(np.argmax(high[node] - low[node]))
            middle = (b - a) // 2
            perm[a:b] = perm[a:b][np.argpartition(own[:, axis], middle)]
            left[node] = grow(a, a + middle)
            right[node] = grow(a + middle, b)
        return node

    grow(0, len(points))
    by_leaf = np.concatenate([ids[starts[p] : ends[p]] for p in perm])
    at = np.concatenate([[0], np.cumsum((ends - starts)[perm])])
    return Tree(points[perm], by_leaf, at, np.array(low), np.array(high), np.array(left), np.array(right), np.array(span))


def limits(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The largest inner product that each box allows with each query."""
    return np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T


def search(tree: Tree, query: np.ndarray, own: int, k: int, bound: float) -> list[tuple[float, int]]:
    """Up to k (score, id), best first, none below ``bound``; each id once, at its best score; ties to smaller ids."""
    allowed = limits(query, tree.low, tree.high)
    best: list[tuple[float, int]] = []  # a heap of (score, -id)
    queue = [(-allowed[0], 0)]
    while queue:
        limit, node = heapq.heappop(queue)
        floor = max(bound, best[0][0]) if len(best) == k else bound
        if -limit < floor:
            break
        if tree.left[node] >= 0:
            for child in (int(tree.left[node]), int(tree.right[node])):
                if allowed[child] >= floor:
                    heapq.heappush(queue, (-allowed[child], child))
            continue
        a, b = tree.span[node]
        score = tree.points[a:b] @ query
        near = np.flatnonzero(score >= floor)
        for p in near[np.argsort(-score[near], kind="stable")]:
            if len(best) == k and score[p] < best[0][0]:
                break
            for i in tree.ids[tree.at[a + p] : tree.at[a + p + 1]]:
                entry = (float(score[p]), -int(i))
                if i == own or len(best) == k and entry <= best[0]:
                    continue
                held = next((n for n, (_, other) in enumerate(best) if other == entry[1]), None)
                if held is not None:
                    best[held] = max(best[held], entry)
                    heapq.heapify(best)
                elif len(best) < k:
                    heapq.heappush(best, entry)
                else:
                    heapq.heapreplace(best, entry)
    return sorted(((s, -i) for s, i in best), key=lambda x: (-x[0], x[1]))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64).reshape(len(column), -1)


def _top_splits(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Axis and cut of the nodes of a complete tree; node n has the children 2n + 1 and 2n + 2."""
    axis, cut = np.zeros(2**depth - 1, np.int64), np.zeros(2**depth - 1)

    def split(node: int, rows: np.ndarray) -> None:
        if node >= len(axis) or not len(rows):
            return
        axis[node] = int(np.argmax(rows.max(0) - rows.min(0)))
        values = rows[:, axis[node]]
        cut[node] = float(np.median(values))
        split(2 * node + 1, rows[values <= cut[node]])
        split(2 * node + 2, rows[values > cut[node]])

    split(0, sample)
    return axis, cut


def _celled(splits):
    """Vectors with the cell that the top splits of their length send them to (cell 0 for a length without splits)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            cell = np.zeros(len(f), np.int64)
            for dim, rows in f.groupby("dim").indices.items():
                if dim in splits.value:
                    axis, cut = splits.value[dim]
                    v, node = _matrix(f["v"].iloc[rows]), np.zeros(len(rows), np.int64)
                    while len(axis) and node[0] < len(axis):
                        node = 2 * node + 1 + (v[np.arange(len(v)), axis[node]] > cut[node])
                    cell[rows] = node
            yield f.assign(cell=cell)

    return run


def _grown(f: pd.DataFrame) -> pd.DataFrame:
    tree = build(_matrix(f["v"]), f["id"].to_numpy(np.int64))
    return f.iloc[:1][["team", "slot", "dim"]].assign(low=[tree.low[0]], high=[tree.high[0]], tree=[tree.packed()])


def _homed(boxes):
    """Queries with the group of the shard whose box allows the largest product."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for part, allowed, (team, _, names) in _allowed(f, boxes.value):
                best = allowed.argmax(1)
                yield part.assign(team=names[team[best]], allowed=allowed[np.arange(len(part)), best])

    return run


def _reached(boxes):
    """Queries with each other group they may find something in, and a bit for each of its shards whose box reaches their bound."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for part, allowed, (team, slot, names) in _allowed(f, boxes.value):
                floor = part["bound"].fillna(-np.inf).to_numpy(np.float64)
                q, s = np.nonzero(allowed >= floor[:, None])
                # Boxes come ordered by group, so the shards of one query and group are neighbours here.
                pair = q * len(names) + team[s]
                at = np.flatnonzero(np.diff(pair, prepend=-1))
                if len(at):
                    out = part.iloc[q[at]].assign(team=names[team[s[at]]], mask=np.bitwise_or.reduceat(np.left_shift(1, slot[s]), at))
                    yield out[out["team"] != out["home"]]

    return run


def _allowed(f: pd.DataFrame, by_dim: dict):
    """Parts of the frame by vector length, with what each box allows, and the boxes' groups, slots and group names."""
    for dim, rows in f.groupby("dim").indices.items():
        if dim in by_dim:
            *named, low, high = by_dim[dim]
            step = max(1, (1 << 21) // len(low))
            for i in range(0, len(rows), step):
                part = f.iloc[rows[i : i + step]]
                yield part, limits(_matrix(part["v"]), low, high), named


def walk(trees: list[Tree], query: np.ndarray, own: int, k: int, bound: float) -> list[tuple[float, int]]:
    """Up to k (score, id) over several trees, best bound first; the kth score is handed on from tree to tree."""
    best: dict[int, float] = {}
    roots = [float(limits(query, t.low[:1], t.high[:1])[0]) for t in trees]
    for place in sorted(range(len(trees)), key=lambda t: -roots[t]):
        if roots[place] < bound:
            break
        for score, i in search(trees[place], query, own, k, bound):
            best[i] = max(score, best.get(i, score))
        ranked = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
        best = dict(ranked)
        if len(ranked) == k:
            bound = max(bound, ranked[-1][1])
    return [(s, i) for i, s in best.items()]


def _group_search(k: int):
    def run(shards: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(shards) and len(queries):
            trees = {int(slot): Tree.unpacked(tree) for slot, tree in zip(shards["slot"], shards["tree"], strict=True)}
            bounds = queries["bound"].fillna(-np.inf).to_numpy(np.float64)
            for query, own, bound, mask in zip(_matrix(queries["v"]), queries["id"], bounds, queries["mask"], strict=True):
                wanted = [tree for slot, tree in trees.items() if mask >> slot & 1]
                out += [(own, i, int(s)) for s, i in walk(wanted, query, own, k, bound)]
        return pd.DataFrame(np.array(out, np.int64).reshape(-1, 3), columns=["query_id", "vec_id", "score"])

    return run


def _usable(rows: DataFrame) -> DataFrame:
    return rows.where("id is not null and v is not null").select(F.col("id").cast("long").alias("id"), "v", F.size("v").alias("dim")).dropDuplicates(["id", "v"])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = 8192, query_rows: int = 4096, sample_rows: int = 20_000) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best inner products of each query, exactly.

    ``vectors`` and ``queries`` hold ``id`` long and ``v``, an array of whole numbers as doubles
    whose products sum below 2^53 (larger ones round).  A query does not find its own id.
    Ties go to smaller ids.  An id is found once: repeated rows count as one, and of different
    vectors with one id, or of different queries with one id, the best score holds.  Only vectors of a query's length are compared.  Null ids or vectors
    take no part; fewer candidates give fewer rows; empty tables give none; other columns are ignored.
    About ``sample_rows`` vectors, drawn by hash, fit the splits that deal vectors over shards; that
    bears on speed alone.  Boxes are broadcast ``BOX_BYTES`` at a time; a tree holds at most about
    ``shard_rows`` vectors and ``TREE_BYTES``, and ``GROUP`` trees meet ``query_rows`` queries in a task.
    """
    spark = vectors.sparkSession
    # Of equal vectors the k + 1 smallest ids are enough for any query; Spark prunes them before the shuffle.
    place = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    vectors = written(_usable(vectors).withColumn("_n", place).where(F.col("_n") <= k + 1).drop("_n"), "vectors")
    queries = written(_usable(queries), "asked")
    sizes = {r["dim"]: r["n"] for r in vectors.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    total, widest = sum(sizes.values()), max(sizes, default=1)
    rows_each = max(1, min(shard_rows, TREE_BYTES // (8 * max(1, widest))))
    drawn = vectors.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, sample_rows / max(1, total))))
    sample: dict[int, list] = {}
    for r in drawn.select("dim", "v").toLocalIterator():
        sample.setdefault(r["dim"], []).append(r["v"])
    depth = lambda dim: max(0, (-(-sizes[dim] // rows_each) - 1).bit_length())
    splits = spark.sparkContext.broadcast({dim: _top_splits(np.array(v, np.float64).reshape(len(v), dim), depth(dim)) for dim, v in sample.items()})
    celled = written(vectors.mapInPandas(_celled(splits), "id long, v array<double>, dim int, cell long"), "celled")
    # A row per cell, so about two per ``rows_each`` vectors.
    cells = celled.groupBy("dim", "cell").agg(F.ceil(F.count("*") / rows_each).alias("parts"))
    part = F.pmod(F.xxhash64("v"), F.col("parts"))
    dealt = celled.join(cells.hint("shuffle_hash"), ["dim", "cell"]).withColumn("part", part)
    team = F.concat_ws("-", "dim", F.floor(F.col("cell") / GROUP_CELLS), F.floor(F.col("part") / GROUP_PARTS))
    slot = (F.pmod("cell", F.lit(GROUP_CELLS)) * GROUP_PARTS + F.pmod("part", F.lit(GROUP_PARTS))).cast("int")
    dealt = dealt.select("id", "v", "dim", team.alias("team"), slot.alias("slot"))
    trees = written(dealt.groupBy("team", "slot").applyInPandas(_grown, "team string, slot int, dim int, low array<double>, high array<double>, tree binary"), "trees")

    boxes = trees.select("team", "slot", "dim", "low", "high")
    rounds = max(1, -(-trees.count() * 16 * max(1, widest) // BOX_BYTES))

    def met(asked: DataFrame, schema: str, kernel) -> DataFrame:
        """What the kernel finds for the queries in the boxes, a bounded share of the groups at a time."""
        out = None
        for turn in range(rounds):
            by_dim: dict[int, list] = {}
            for r in boxes.where(F.pmod(F.xxhash64("team"), F.lit(rounds)) == turn).toLocalIterator():
                by_dim.setdefault(r["dim"], []).append((r["team"], r["slot"], r["low"], r["high"]))
            arrays = {}
            for dim, found in by_dim.items():
                found.sort(key=lambda x: x[:2])
                names, place = np.unique(np.array([x[0] for x in found], object), return_inverse=True)
                low, high = (np.array([x[n] for x in found], np.float64).reshape(len(found), dim) for n in (2, 3))
                arrays[dim] = (place, np.array([x[1] for x in found], np.int64), names, low, high)
            part = asked.mapInPandas(kernel(spark.sparkContext.broadcast(arrays)), schema)
            out = part if out is None else out.unionByName(part)
        return out

    n_blocks = max(1, -(-queries.count() // query_rows))

    def searched(asked: DataFrame) -> DataFrame:
        asked = asked.select("team", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(n_blocks)).alias("block"), "id", "v", "bound", "mask")
        needed = asked.select(F.col("team").alias("_team"), F.col("block").alias("_block")).distinct()
        grown = trees.join(needed, F.col("team") == F.col("_team")).select("team", F.col("_block").alias("block"), "slot", "tree")
        found = grown.groupBy("team", "block").cogroup(asked.groupBy("team", "block")).applyInPandas(_group_search(k), "query_id long, vec_id long, score long")
        return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))

    kind = "id long, v array<double>, dim int"
    best = met(queries, f"{kind}, team string, allowed double", _homed)
    homes = written(best.groupBy("id", "v", "dim").agg(F.max_by("team", F.struct("allowed", "team")).alias("home")), "homes")
    pilot = written(searched(homes.select("id", "v", F.col("home").alias("team"), F.lit(None).cast("double").alias("bound"), F.lit((1 << GROUP) - 1).cast("long").alias("mask"))), "pilot")
    kth = pilot.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("bound"))
    wide = written(met(homes.join(kth, "id", "left"), f"{kind}, home string, bound double, team string, mask long", _reached), "reached")
    found = pilot.unionByName(searched(wide)).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
