"""Boosted regression trees grown leaf by leaf, for many (fold, candidate) models at once.

Features are binned once, a byte each.  A fold whose binned rows are not beyond ``HELD`` bytes is copied to a few tasks, each of which boosts some of
the candidates from first round to last: many folds and candidates at once, and no job per round.  Rows of larger folds stay spread over all tasks and
are stored in blocks of one (fold, role), a column's numbers after one another as bytes.  A pass over the blocks adds up gradient histograms for every leaf of every model
that the growth asks for: a task sums its own rows in Arrow batches, the sums meet by (model, leaf), and the best split of each leaf
comes to the driver, a few numbers a leaf.  There a queue takes the leaf of largest gain first until the tree has its leaves.
A round's scores go with the rows into a stored table, and validation rank IC is taken from it.  A model that has not improved for
``patience`` rounds stops.  Gradients are summed as whole numbers, so trees depend neither on partitions nor on which of the two ways a fold takes.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.operators.contracts import ContractError
from tidepanel.operators.cross_section import rank_ic
from tidepanel.operators.evidence import ic_statistics
from tidepanel.sources.sinks import discard, written

#: The parameter grid that is searched.
GRID = {"num_leaves": [15, 31], "learning_rate": [0.03, 0.05], "min_data_in_leaf": [100, 300], "lambda_l2": [1.0, 10.0]}
#: Shares of rows and features that a tree sees, and the seed.
SHARES = {"bagging_fraction": 0.8, "feature_fraction": 0.8, "seed": 42}
#: What a candidate has unless it says otherwise.
DEFAULTS = {"num_leaves": 31, "learning_rate": 0.1, "min_data_in_leaf": 20, "lambda_l1": 0.0, "lambda_l2": 0.0, "max_depth": -1, "bagging_fraction": 1.0, "feature_fraction": 1.0, "seed": 0}
#: Gradients and weights are multiples of 1 / SCALE.
SCALE = float(1 << 20)
LEAST_HESSIAN, LEAST_GAIN = 1e-3, 1e-12
TRAIN, VALIDATION, TEST = 0, 1, 2
#: Rows of a block at most, and blocks of a batch whose sums are taken together.
BLOCK, TOGETHER = 4096, 8
#: Bytes of a fold's binned rows that a task boosts by itself; bytes of copied rows that a spread over more tasks may cost; rows of a leaf whose features are summed as one.
HELD, COPIED, FEW = 3 << 27, 1 << 30, 1024
_STATE = "fold string, chunk int, role int, n int, day binary, u binary, y binary, w binary, x binary, scores binary"
_NODE = "node int, feature string, bin int, threshold double, gain double, left int, right int, value double, n_rows long"
_STATISTICS = "n long, mean_rank_ic double, rank_ic_std double, rank_icir double, positive_ratio double"
TREES, ROUNDS = (f"fold string, candidate_id int, iteration int, {rest}" for rest in (_NODE, _STATISTICS))


def normal_cuts(n_features: int, bins: int = 32) -> np.ndarray:
    """Cut points of standardised features: equal shares of a normal variable, the same for all; no row is looked at."""
    return np.tile([NormalDist().inv_cdf(k / bins) for k in range(1, bins)], (n_features, 1))


def quantile_cuts(rows: DataFrame, features: list[str], bins: int = 32, accuracy: int = 10_000) -> np.ndarray:
    """Cut points at the approximate quantiles of each feature, NULLs left out; one pass."""
    shares = [k / bins for k in range(1, bins)]
    row = rows.agg(*(F.percentile_approx(F.col(f).cast("double"), shares, accuracy).alias(f"c{k}") for k, f in enumerate(features))).first()
    return np.array([row[k] if row[k] else [0.0] * (bins - 1) for k in range(len(features))], np.float64)


def _binned(cuts: np.ndarray, features: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = bins_of(np.stack([batch.column(n).to_numpy(zero_copy_only=False).astype(np.float64) for n in features], 1), cuts)
            kept = [n for n in batch.schema.names if n not in features]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), _bytes(x)], names=[*kept, "x"])

    return run


def bins_of(x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """A byte per value of ``x[row, feature]``: the number of cut points below it; NaN is 0."""
    out = np.empty(x.T.shape, np.uint8)
    for k, (own, value) in enumerate(zip(cuts, np.ascontiguousarray(x.T), strict=True)):
        out[k] = np.where(np.isnan(value), 0, np.searchsorted(own, value, "left"))
    return out.T


def _bytes(x: np.ndarray) -> pa.Array:
    ends = np.arange(0, x.size + 1, max(1, x.shape[1]), dtype=np.int32) if x.shape[1] else np.zeros(len(x) + 1, np.int32)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(x))])


def _matrix(x: pa.Array, n_features: int) -> np.ndarray:
    """The bytes of a binary column, as many in each row, as a matrix; nothing is copied."""
    ends = np.frombuffer(x.buffers()[1], np.int32, len(x) + 1, 4 * x.offset)
    return np.frombuffer(x.buffers()[2], np.uint8, int(ends[-1] - ends[0]), int(ends[0])).reshape(len(x), n_features) if ends[-1] > ends[0] else np.zeros((len(x), n_features), np.uint8)


def binned(rows: DataFrame, features: list[str], cuts: np.ndarray) -> DataFrame:
    """``rows`` with ``x``, a byte per feature, in place of the features: the number of cut points below the value; NULL and NaN are 0."""
    rest = [c for c in rows.columns if c not in features]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in rows.select(*rest).dtypes), "x binary"])
    return rows.select(*rest, *(F.col(f).cast("double") for f in features)).mapInArrow(_binned(cuts, features), schema)


def _ready(rows: DataFrame, features: list[str], cuts: np.ndarray) -> DataFrame:
    return rows if "x" in rows.columns else binned(rows, features, cuts)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Scrambled 64-bit numbers (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _draw(of: np.ndarray, seed: int, iteration: int) -> np.ndarray:
    key = _mixed(np.array([seed * 1_000_003 + iteration + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return _mixed(of.astype(np.uint64) ^ key) / float(1 << 64)


def seen_features(n: int, candidate: dict, iteration: int) -> np.ndarray:
    """Places of the features that a tree may split on, ascending."""
    many = max(1, int(np.ceil(candidate["feature_fraction"] * n)))
    return np.sort(np.argsort(_draw(np.arange(1, n + 1), candidate["seed"] + 1, iteration), kind="stable")[:many])


def seen_rows(u: np.ndarray, candidate: dict, iteration: int) -> np.ndarray:
    """Rows, by their hashes, that a tree is grown on."""
    if candidate["bagging_fraction"] >= 1:
        return np.ones(len(u), bool)
    return _draw(u.view(np.uint64), candidate["seed"], iteration) < candidate["bagging_fraction"]


@dataclass
class Tree:
    """Nodes as arrays; ``feature`` is -1 at a leaf; bins up to ``bin`` go left."""

    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    rows: np.ndarray

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        node, at = np.zeros(len(x), np.int64), np.arange(len(x))
        while len(at):
            at = at[self.feature[node[at]] >= 0]
            own = node[at]
            low = x[at, self.feature[own]] <= self.bin[own]
            node[at] = np.where(low, self.left[own], self.right[own])
        return node


@dataclass
class _Node:
    depth: int
    path: int = 1  # the root's is 1, a child's twice its parent's and one more to the right; of equal gains the smaller is split first
    sums: tuple[float, float, int] | None = None
    split: tuple | None | bool = None  # None: not known, False: there is none, else (feature, bin, gain, left sums)
    left: int = -1
    right: int = -1


@dataclass
class Growth:
    """A tree while it grows; nodes stay once made, the queue runs anew over what is known."""

    candidate: dict
    nodes: list[_Node] = field(default_factory=lambda: [_Node(0)])
    taken: list[int] = field(default_factory=list)

    def wanted(self) -> list[int]:
        """Leaves whose best splits have to be known before the next pass of the queue; none if the tree is done."""
        c, queue, unknown, leaves = self.candidate, [], [], 1
        self.taken = []

        def consider(i: int) -> None:
            node = self.nodes[i]
            if node.split is None:
                unknown.append(i)
            elif node.split:
                heapq.heappush(queue, (-node.split[2], node.path, i))

        if not self.unsplittable(0):
            consider(0)
        while queue and leaves < c["num_leaves"]:
            i = heapq.heappop(queue)[2]
            node = self.divided(i)
            self.taken.append(i)
            leaves += 1
            if leaves < c["num_leaves"]:
                for child in (node.left, node.right):
                    if not self.unsplittable(child):
                        consider(child)
        return unknown

    def unsplittable(self, i: int) -> bool:
        """Whether depth or number of rows leave no split."""
        c, node = self.candidate, self.nodes[i]
        return 0 <= c["max_depth"] <= node.depth or node.sums is not None and node.sums[2] < 2 * c["min_data_in_leaf"]

    def divided(self, i: int) -> _Node:
        """The node, which has its children from now on."""
        node = self.nodes[i]
        if node.left < 0:
            near = node.split[3]
            far = tuple(a - b for a, b in zip(node.sums, near, strict=True))
            node.left, node.right = len(self.nodes), len(self.nodes) + 1
            self.nodes += [_Node(node.depth + 1, 2 * node.path, near), _Node(node.depth + 1, 2 * node.path + 1, far)]
        return node

    def shape(self, only: set[int] | None = None) -> tuple[Tree, dict[int, int]]:
        """All nodes made so far, or those below the splits ``only``, as a tree; and the places of nodes in it."""
        order, place = [0], {0: 0}
        for i in order:
            node = self.nodes[i]
            if node.left >= 0 and (only is None or i in only):
                for child in (node.left, node.right):
                    place[child] = len(order)
                    order.append(child)
        n = len(order)
        t = Tree(np.full(n, -1), np.zeros(n, np.int64), np.full(n, -1), np.full(n, -1), np.zeros(n), np.zeros(n), np.zeros(n, np.int64))
        for k, i in enumerate(order):
            node = self.nodes[i]
            if node.sums is not None:
                g, h, t.rows[k] = node.sums
                t.value[k] = -self.candidate["learning_rate"] * _soft(g, self.candidate["lambda_l1"]) / max(h + self.candidate["lambda_l2"], 1e-300)
            if node.left in place and (only is None or i in only):
                t.feature[k], t.bin[k], t.gain[k] = node.split[:3]
                t.left[k], t.right[k] = place[node.left], place[node.right]
        return t, place


def _soft(g, l1):
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def best_split(sums: np.ndarray, candidate: dict) -> tuple[tuple[float, float, int], tuple | bool]:
    """Sums of a leaf, and its best (feature, bin, gain, left sums) or False; ``sums[feature, bin]`` are gradient, weight and rows.

    Of equal gains the smaller feature, then the smaller bin is taken.
    """
    total = sums[0].sum(0)
    low = sums.cumsum(1)[:, :-1]
    high = total - low
    l1, l2 = candidate["lambda_l1"], candidate["lambda_l2"]

    def strength(part: np.ndarray) -> np.ndarray:
        return _soft(part[..., 0] / SCALE, l1) ** 2 / np.maximum(part[..., 1] / SCALE + l2, 1e-300)

    gain = strength(low) + strength(high) - strength(total)
    fits = (np.minimum(low[..., 2], high[..., 2]) >= max(1, candidate["min_data_in_leaf"])) & (np.minimum(low[..., 1], high[..., 1]) / SCALE >= LEAST_HESSIAN)
    gain = np.where(fits, gain, -np.inf)
    own = (total[0] / SCALE, total[1] / SCALE, int(total[2]))
    if not gain.size or not gain.max() > LEAST_GAIN:
        return own, False
    f, b = np.unravel_index(int(gain.argmax()), gain.shape)
    return own, (int(f), int(b), float(gain[f, b]), (low[f, b, 0] / SCALE, low[f, b, 1] / SCALE, int(low[f, b, 2])))


def _packed_blocks(n_features: int, start: dict, chunk_size: int, candidates: int):
    """The rows of a task as blocks of one (fold, chunk, role): a column's numbers as bytes, features and candidates' scores one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def block(key: tuple, many: int) -> pa.RecordBatch:
            parts = [np.concatenate(c, -1) for c in zip(*held[key], strict=True)]
            rest = [c[..., many:] for c in parts]
            held[key] = [rest] if rest[0].size else []
            parts = [np.ascontiguousarray(c[..., :many]) for c in parts]
            scores = np.full((min(chunk_size, candidates - key[1] * chunk_size), len(parts[0])), start[key[0]])
            columns = [key[0]], [key[1]], [key[2]], [len(parts[0])], *([c.tobytes()] for c in (*parts, scores))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _KINDS, strict=True)], names=_STATE.replace(",", "").split()[::2])

        for batch in batches:
            fold, chunk, role = batch.column("fold").dictionary_encode(), batch.column("chunk").to_numpy(), batch.column("role").to_numpy()
            names = fold.dictionary.to_pylist()
            code = (fold.indices.to_numpy().astype(np.int64) * (int(chunk.max(initial=0)) + 1) + chunk) * 3 + role
            x = _matrix(batch.column("x"), n_features)
            numbers = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("day", "u", "y", "w")]
            for k in np.unique(code).tolist():
                at = np.flatnonzero(code == k)
                key = (names[fold.indices[int(at[0])].as_py()], int(chunk[at[0]]), int(role[at[0]]))
                held.setdefault(key, []).append([*(c[at] for c in numbers), x[at].T])
                while sum(len(p[0]) for p in held[key]) >= BLOCK:
                    yield block(key, BLOCK)
        for key in list(held):
            if held[key]:
                yield block(key, BLOCK)

    return run


_KINDS = (pa.string(), pa.int32(), pa.int32(), pa.int32(), *(pa.binary() for _ in range(6)))


def _blocks(batch: pa.RecordBatch, n_features: int) -> Iterator[tuple[tuple, dict[str, np.ndarray]]]:
    """(fold, chunk) and the arrays of each block; ``x[feature, row]`` and ``scores[candidate, row]``; nothing is copied."""
    kinds = {"day": np.int32, "u": np.int64, "y": np.float64, "w": np.float64, "x": np.uint8, "scores": np.float64}
    for i, (fold, chunk, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("fold", "chunk", "n")), strict=True)):
        own = {c: np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in kinds.items() if c in batch.schema.names}
        yield (fold, chunk), own | {c: own[c].reshape(many, n) for c, many in (("x", n_features), ("scores", -1)) if c in own}


def _groups(batch: pa.RecordBatch, n_features: int) -> Iterator[tuple[tuple, dict[str, np.ndarray]]]:
    """Blocks of one (fold, chunk), up to ``TOGETHER``, as one."""
    held: dict = {}
    whole = lambda blocks: blocks[0] if len(blocks) == 1 else {c: np.concatenate([b[c] for b in blocks], -1) for c in blocks[0]}
    for key, block in _blocks(batch, n_features):
        held.setdefault(key, []).append(block)
        if len(held[key]) == TOGETHER:
            yield key, whole(held.pop(key))
    for key, blocks in held.items():
        yield key, whole(blocks)


def _added(x: np.ndarray, leaf: np.ndarray, many: int, bins: int, g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Sums of gradients, weights and rows ``[what, feature, leaf, bin]``; ``x`` has a row per feature, all numbers are whole.

    Weights and rows are added as one number, as long as it stays whole.
    """
    size, out = many * bins, np.empty((3, len(x), many * bins))
    shift = float(1 << len(h).bit_length())
    both = h * shift + 1 if h.sum() * shift < 2.0**52 else None
    start = leaf * bins
    for f, own in enumerate(x):
        at = start + own
        out[0, f] = np.bincount(at, g, size)
        out[1, f] = np.bincount(at, h if both is None else both, size)
        if both is None:
            out[2, f] = np.bincount(at, minlength=size)
    if both is not None:
        out[2] = out[1] % shift
        out[1] = (out[1] - out[2]) / shift
    return out.reshape(3, len(x), many, bins)


def _histograms(shared):
    """Sums of each wanted leaf over a task's rows: fold, candidate, leaf, and the numbers as bytes.

    Candidates that see the same rows and features share what is taken of a block, features in rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, chunk_size, n_features, bins, iteration = shared.value
        total: dict = {}
        for batch in batches:
            for (fold, chunk), block in _groups(batch, n_features):
                scores, y, w, u = (block[c] for c in ("scores", "y", "w", "u"))
                taken: dict = {}
                for k in range(len(scores)):
                    key = (fold, chunk * chunk_size + k)
                    if key not in asked:
                        continue
                    candidate, tree, wanted = asked[key]
                    share = tuple(candidate[c] for c in ("bagging_fraction", "feature_fraction", "seed"))
                    if share not in taken:
                        taken[share] = seen_rows(u, candidate, iteration), block["x"][seen_features(n_features, candidate, iteration)]
                    seen, columns = taken[share]
                    slot = np.full(len(tree.feature), -1)
                    slot[wanted] = np.arange(len(wanted))
                    leaf = slot[tree.leaf_of(block["x"].T)]
                    own = np.flatnonzero(seen & (leaf >= 0))  # rows of other leaves are not copied
                    g = np.rint(w[own] * (scores[k, own] - y[own]) * SCALE)
                    sums = _added(columns.take(own, 1), leaf[own], len(wanted), bins, g, np.rint(w[own] * SCALE))
                    if key in total:
                        total[key] += sums
                    else:
                        total[key] = sums
        for (fold, number), sums in total.items():
            wanted = asked[fold, number][2]
            parts = [np.ascontiguousarray(sums[:, :, i].transpose(1, 2, 0)).tobytes() for i in range(len(wanted))]
            yield pa.RecordBatch.from_arrays([pa.array([fold] * len(wanted)), pa.array([number] * len(wanted), pa.int32()), pa.array(wanted, pa.int32()), pa.array(parts, pa.binary())], names=["fold", "number", "leaf", "sums"])

    return run


def _splits(shared):
    """The sums of each leaf over all tasks, and the best split of each; a task holds the leaves dealt to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, _, n_features, bins, iteration = shared.value
        total: dict = {}
        for batch in batches:
            for fold, number, leaf, sums in zip(*(batch.column(c).to_pylist() for c in ("fold", "number", "leaf", "sums")), strict=True):
                key = (fold, number, leaf)
                total[key] = total.get(key, 0.0) + np.frombuffer(sums)
        out = []
        for (fold, number, leaf), sums in total.items():
            candidate = asked[fold, number][0]
            seen = seen_features(n_features, candidate, iteration)
            (g, h, n), split = best_split(sums.reshape(len(seen), bins, 3), candidate)
            f, b, gain, (lg, lh, ln) = split or (None, None, None, (None, None, None))
            out.append((fold, number, leaf, g, h, n, None if f is None else int(seen[f]), b, gain, lg, lh, ln))
        if out:
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=_SPLIT.replace(",", "").split()[::2])

    return run


_SPLIT = "fold string, number int, leaf int, g double, h double, n long, feature int, bin int, gain double, lg double, lh double, ln long"


def _advanced(shared, chunk_size: int, n_features: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = shared.value
        for batch in batches:
            after = []
            for (fold, chunk), block in _blocks(batch, n_features):
                scores = block["scores"].copy()
                for k in range(len(scores)):
                    tree = made.get((fold, chunk * chunk_size + k))
                    if tree is not None:
                        scores[k] += tree.value[tree.leaf_of(block["x"].T)]
                after.append(scores.tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names[:-1]), pa.array(after, pa.binary())], names=batch.schema.names)

    return run


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``fold, chunk, k, day, y, score``: a row per row and candidate."""
    for batch in batches:
        for (fold, chunk), block in _blocks(batch, 0):
            for k, score in enumerate(block["scores"]):
                m = len(score)
                columns = pa.array([fold] * m), pa.array(np.full(m, chunk, np.int32)), pa.array(np.full(m, k, np.int32)), pa.array(block["day"]), pa.array(block["y"]), pa.array(score)
                yield pa.RecordBatch.from_arrays(list(columns), names=["fold", "chunk", "k", "day", "y", "score"])


def _fallen(tree: Tree, x: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each leaf that rows ``at`` come to, with those; ``x`` has a row per feature."""
    held = [(0, at)]
    while held:
        node, own = held.pop()
        if tree.feature[node] < 0:
            yield node, own
        elif len(own):
            low = x[tree.feature[node]].take(own) <= tree.bin[node]
            held += [(tree.left[node], own[low]), (tree.right[node], own[~low])]


def _pairs(x: np.ndarray, columns: np.ndarray, bins: int) -> np.ndarray:
    """The bins of two features after one another as one number; a last single one stands beside zeros."""
    out = x[columns[0::2]].astype(np.uint16) * bins
    out[: len(columns) // 2] += x[columns[1::2]]
    return out


def _leaf_sums(pairs: np.ndarray, own: np.ndarray, n_features: int, bins: int, g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Sums of gradients, weights and rows ``[what, feature, bin]`` over rows ``own``; all numbers are whole."""
    out, numbers = np.empty((3, n_features, bins)), [g.take(own), h.take(own)]
    shift = float(1 << len(own).bit_length())
    packed = numbers[1].sum() * shift < 2.0**52  # weights and rows are added as one number, as long as it stays whole
    numbers = [numbers[0], numbers[1] * shift + 1] if packed else [*numbers, None]
    many = n_features // 2
    if len(own) < FEW:
        both = pairs.take(own, 1)
        code = np.concatenate([both // bins, both[:many] % bins]) + np.arange(0, n_features * bins, bins)[:, None]
        for k, number in enumerate(numbers):
            sums = np.bincount(code.ravel(), None if number is None else np.tile(number, n_features), n_features * bins).reshape(n_features, bins)
            out[k, 0::2], out[k, 1::2] = sums[: len(pairs)], sums[len(pairs) :]
    else:
        for f, pair in enumerate(pairs):
            code = pair.take(own).astype(np.intp)
            for k, number in enumerate(numbers):
                sums = np.bincount(code, number, bins * bins).reshape(bins, bins)
                out[k, 2 * f] = sums.sum(1)
                if f < many:
                    out[k, 2 * f + 1] = sums.sum(0)
    if packed:
        out[2] = out[1] % shift
        out[1] = (out[1] - out[2]) / shift
    return out


def _grown(x: np.ndarray, at: np.ndarray, g: np.ndarray, h: np.ndarray, candidate: dict, seen: np.ndarray, bins: int) -> tuple[Growth, dict[int, np.ndarray]]:
    """A tree on rows ``at`` of a task, and the rows of its leaves; of two children the smaller one is summed, the other is what is left of their parent."""
    growth, rows, sums, queue = Growth(candidate), {0: at}, {}, []
    pairs = _pairs(x[:, : len(g)], seen, bins)

    def look(i: int) -> None:
        node = growth.nodes[i]
        own, node.split = best_split(sums[i].transpose(1, 2, 0), candidate)
        node.sums = node.sums or own
        if node.split:
            f, *rest = node.split
            node.split = (int(seen[f]), *rest)
            heapq.heappush(queue, (-node.split[2], node.path, i))

    if not len(at):
        growth.nodes[0].sums = (0.0, 0.0, 0)
    elif not growth.unsplittable(0):
        sums[0] = _leaf_sums(pairs, at, len(seen), bins, g, h)
        look(0)
    while queue and len(growth.taken) + 1 < candidate["num_leaves"]:
        i = heapq.heappop(queue)[2]
        node, whole, own = growth.divided(i), sums.pop(i), rows.pop(i)
        growth.taken.append(i)
        low = x[node.split[0]].take(own) <= node.split[1]
        rows[node.left], rows[node.right] = own[low], own[~low]
        if len(growth.taken) + 1 < candidate["num_leaves"]:
            wanted = [c for c in (node.left, node.right) if not growth.unsplittable(c)]
            if wanted:
                small, large = sorted((node.left, node.right), key=lambda c: len(rows[c]))
                sums[small] = _leaf_sums(pairs, rows[small], len(seen), bins, g, h)
                sums[large] = whole - sums[small]
            for c in wanted:
                look(c)
    return growth, rows


def _places(day: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Average ranks of the values of each day, less the day's mean rank; days are numbers from 0 in order."""
    order = np.lexsort((value, day))
    v, d = value[order], day[order]
    first = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) | (d[1:] != d[:-1])]))
    many = np.diff(np.concatenate([first, [len(v)]]))
    out = np.empty(len(v))
    out[order] = np.repeat(first + (many - 1) / 2, many)
    size = np.bincount(day)
    return out - (np.cumsum(size) - size + (size - 1) / 2)[day]


def _statistics(day: np.ndarray, score: np.ndarray, label: np.ndarray) -> tuple:
    """Number, mean, deviation, their ratio and share above 0 of the days' rank ICs; ``label`` as ``_places``."""
    if not len(day):
        return 0, None, None, None, None
    x = _places(day, np.round(score, 12))  # scores of equal leaves are equal but for their last bits
    xy, xx, yy = (np.bincount(day, v) for v in (x * label, x * x, label * label))
    ics = xy[xx * yy > 0] / np.sqrt(xx * yy)[xx * yy > 0]
    if not len(ics):
        return 0, None, None, None, None
    mean, std = float(ics.mean()), float(ics.std(ddof=1)) if len(ics) > 1 else None
    return len(ics), mean, std, mean / std if std else None, float((ics > 0).mean())


def _boosted(shared):
    """All rounds of the candidates of a task on its rows, which are those of one fold: a row per candidate and round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, candidates, features, cuts, rounds, patience = shared.value
        parts: dict = {TRAIN: [], VALIDATION: []}
        fold, chunk, every = None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            fold, chunk, every = (batch.column(c)[0].as_py() for c in ("fold", "chunk", "chunks"))
            role, x = batch.column("role").to_numpy(), _matrix(batch.column("x"), len(features))
            numbers = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("day", "u", "y", "w")]
            for r, own in parts.items():
                at = np.flatnonzero(role == r)
                own.append([*(c[at] for c in numbers), np.ascontiguousarray(x[at].T)])
        if fold is None:
            return
        many = sum(len(p[0]) for p in parts[TRAIN])
        day, u, y, w, x = (np.concatenate([p.pop(0) for p in (*parts[TRAIN], *parts[VALIDATION])], -1) for _ in range(5))
        w, u = w[:many], u[:many]
        day = np.unique(day[many:], return_inverse=True)[1]
        label, h = _places(day, y[many:]) if len(day) else y[many:], np.rint(w * SCALE)
        for k in range(chunk, len(candidates), every):
            candidate, score, best, out = candidates[k], np.full(len(y), start[fold]), (-np.inf, 0), []
            out.append((fold, k, 0, None, None, None, None, None, [(0, None, None, None, None, None, None, start[fold], None)]))
            for iteration in range(1, rounds + 1):
                if iteration - best[1] > patience:
                    break
                bag = seen_rows(u, candidate, iteration)
                g = np.rint(w * (score[:many] - y[:many]) * SCALE)
                growth, rows = _grown(x, np.flatnonzero(bag), g, h, candidate, seen_features(len(features), candidate, iteration), cuts.shape[1] + 1)
                tree, place = growth.shape(set(growth.taken))
                for i, own in rows.items():
                    score[own] += tree.value[place[i]]
                for leaf, own in _fallen(tree, x, np.concatenate([np.flatnonzero(~bag), np.arange(many, len(y))])):
                    score[own] += tree.value[leaf]
                told = _statistics(day, score[many:], label)
                if told[1] is not None and told[1] > best[0]:
                    best = told[1], iteration
                out.append((fold, k, iteration, *told, [r[3:] for r in _rows((fold, k), iteration, tree, features, cuts)]))
                if len(out) == 64:
                    yield _round_batch(out)
                    out = []
            if out:
                yield _round_batch(out)

    return run


_NODES = pa.list_(pa.struct([("node", pa.int32()), ("feature", pa.string()), ("bin", pa.int32()), ("threshold", pa.float64()), ("gain", pa.float64()), ("left", pa.int32()), ("right", pa.int32()), ("value", pa.float64()), ("n_rows", pa.int64())]))


def _round_batch(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), *(pa.float64() for _ in range(4)), _NODES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[*(c.split()[0] for c in ROUNDS.split(", ")), "nodes"])


def _held(plain: DataFrame, start: dict, sizes: dict, candidates: list[dict], features: list[str], cuts: np.ndarray, rounds: int, patience: int) -> tuple[DataFrame, DataFrame]:
    """Trees and rounds of folds that tasks boost by themselves, the candidates of a fold dealt to several."""
    spark = plain.sparkSession
    chunks = max(-(-spark.sparkContext.defaultParallelism // len(start)), COPIED // max(1, sum(sizes[f] for f in start) * len(features)))
    chunks = min(len(candidates), chunks)
    number = spark.createDataFrame([(f, k) for k, f in enumerate(sorted(start))], "fold string, _number int")
    rows = plain.join(F.broadcast(number), "fold").select("fold", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), F.lit(chunks).alias("chunks"), "role", _day(), "u", "y", "w", "x", "_number")
    rows = rows.repartitionById(len(start) * chunks, F.col("_number") * chunks + F.col("chunk")).drop("_number")
    shared = spark.sparkContext.broadcast((start, candidates, features, cuts, rounds, patience))
    made = written(rows.mapInArrow(_boosted(shared), f"{ROUNDS}, nodes array<struct<{_NODE.replace(' ', ': ').replace(',:', ',')}>>"), "boosted")
    shared.unpersist()
    return made.select("fold", "candidate_id", "iteration", F.inline("nodes")), made.where("iteration > 0").drop("nodes")


def _day():
    return F.coalesce(F.unix_date("signal_date"), F.lit(-(2**31))).alias("day")


@dataclass
class Fitted:
    """``trees``: a row per node (iteration 0 is the start score); ``rounds``: validation statistics per fold, candidate and iteration."""

    trees: DataFrame
    rounds: DataFrame
    features: list[str]
    cuts: np.ndarray


def fit(rows: DataFrame, features: list[str], candidates: list[dict], cuts: np.ndarray, rounds: int, patience: int) -> Fitted:
    """Trees for every fold and candidate.

    ``rows`` hold ``fold, role`` (train, validation; other roles are left out), ``signal_date, security_id, y, w`` and the features, or ``x`` in
    their place where they are ``binned`` already.
    Only train rows are learned from.  A model stops after ``patience`` rounds without a higher mean validation rank IC, or
    after ``rounds``.  Rows without a label or weight, or with one that is not finite, take no part; a fold without train rows has no model.
    ``candidates`` are dicts of ``num_leaves, learning_rate, min_data_in_leaf, lambda_l1, lambda_l2, max_depth,
    bagging_fraction, feature_fraction, seed``; what is not given is as in ``DEFAULTS``.
    """
    spark = rows.sparkSession
    if unknown := {k for c in candidates for k in c} - set(DEFAULTS):
        raise ContractError(f"unknown parameters {sorted(unknown)}")
    if not candidates or rounds < 1 or patience < 1:
        raise ContractError("at least one candidate, round and round of patience")
    candidates = [DEFAULTS | c for c in candidates]
    n, bins = len(features), cuts.shape[1] + 1
    finite = lambda c: ~F.isnan(c) & (F.abs(c) < float("inf"))
    role = F.when(F.col("role") == "train", TRAIN).when(F.col("role") == "validation", VALIDATION)
    known = rows.where(finite(F.col("y")) & finite(F.col("w"))).withColumn("role", role).where("role is not null")
    known = known.select(F.col("fold").cast("string").alias("fold"), "role", F.col("signal_date").cast("date").alias("signal_date"), F.col("security_id").cast("string").alias("security_id"), F.col("y").cast("double").alias("y"), F.col("w").cast("double").alias("w"), *(["x"] if "x" in rows.columns else features))
    known = _ready(known.withColumn("u", F.xxhash64("signal_date", "security_id")), features, cuts)
    stored = "x" in rows.columns and hasattr(rows, "stored_at")  # binned and stored already: read as they are
    plain = known if stored else written(known, "binned")
    means = plain.where("role is not null").groupBy("fold").agg(F.try_divide(*(F.sum(F.when(F.col("role") == TRAIN, c)) for c in (F.col("y") * F.col("w"), F.col("w")))).alias("m"), F.count(F.lit(1)).alias("n")).collect()  # a row per fold
    start, sizes = {r["fold"]: round(r["m"], 12) for r in means if r["m"] is not None}, {r["fold"]: r["n"] for r in means}
    held = {f: s for f, s in start.items() if sizes[f] * n <= HELD}
    spread = {f: s for f, s in start.items() if f not in held}
    parts = [(spark.createDataFrame([], TREES), spark.createDataFrame([], ROUNDS))]
    if held:
        parts.append(_held(plain, held, sizes, candidates, features, cuts, rounds, patience))
    if spread:
        parts += _in_passes(plain, spread, sum(sizes[f] for f in spread), candidates, features, cuts, rounds, patience)
    if not stored:
        discard(plain)
    made, told = (reduce(DataFrame.unionByName, p) for p in zip(*(parts[1:] or parts), strict=True))
    return Fitted(made, told, features, cuts)


def _in_passes(plain: DataFrame, start: dict, size: int, candidates: list[dict], features: list[str], cuts: np.ndarray, rounds: int, patience: int) -> list[tuple[DataFrame, DataFrame]]:
    """Trees and rounds of folds whose rows are spread over all tasks, in parts."""
    spark, n, bins = plain.sparkSession, len(features), cuts.shape[1] + 1
    cores = spark.sparkContext.defaultParallelism
    chunks = min(len(candidates), max(1, -(-cores // max(1, len(start) * -(-size // 65536)))))
    chunk_size = -(-len(candidates) // chunks)
    spread = F.explode(F.sequence(F.lit(0), F.lit(-(-len(candidates) // chunk_size) - 1))).alias("chunk")
    state = plain.where(F.col("fold").isin(list(start))).select("fold", spread, "role", _day(), "u", "y", "w", "x")
    state = state.repartitionByRange(max(cores, -(-size * chunks // 32768)), "fold", "chunk", "u")
    state = written(state.mapInArrow(_packed_blocks(n, start, chunk_size, len(candidates)), _STATE), "state")
    models = {(f, k): c for f in start for k, c in enumerate(candidates)}
    best: dict = {m: (-np.inf, 0) for m in models}
    nodes = [(f, k, 0, 0, None, None, None, None, None, None, start[f], None) for f, k in models]
    seen: list[tuple] = []
    parts = []
    for iteration in range(1, rounds + 1):
        active = {m: Growth(c) for m, c in models.items() if iteration - best[m][1] <= patience}
        if not active:
            break
        _grow(state, active, chunk_size, n, bins, iteration)
        made = {}
        for m, growth in active.items():
            made[m], _ = growth.shape(set(growth.taken))
            nodes += _rows(m, iteration, made[m], features, cuts)
        shared = spark.sparkContext.broadcast(made)
        old, state = state, written(state.mapInArrow(_advanced(shared, chunk_size, n), _STATE), "state")
        discard(old)
        shared.unpersist()
        each = state.where(f"role = {VALIDATION}").select("fold", "chunk", "n", "day", "y", "scores").mapInArrow(_unpacked, "fold string, chunk int, k int, day int, y double, score double")
        each = each.withColumn("number", F.col("chunk") * chunk_size + F.col("k"))
        # scores of equal leaves are equal but for their last bits
        ics = rank_ic(each.withColumn("score", F.round("score", 12)), "score", "y", "day", "fold", "number")
        told = dict.fromkeys(active, (0, None, None, None, None))
        told |= {(r["fold"], r["number"]): (r["n"], r["mean"], r["std"], r["icir"], r["positive_ratio"]) for r in ic_statistics(ics, "rank_ic", ["fold", "number"]).collect()}
        for m in active:
            seen.append((*m, iteration, *told[m]))
            if told[m][1] is not None and told[m][1] > best[m][0]:
                best[m] = (told[m][1], iteration)
        if len(nodes) > 100_000:  # the driver keeps no more of them
            parts.append((written(spark.createDataFrame(nodes, TREES), "trees"), spark.createDataFrame(seen, ROUNDS)))
            nodes, seen = [], []
    discard(state)
    if nodes:
        parts.append((spark.createDataFrame(nodes, TREES), spark.createDataFrame(seen, ROUNDS)))
    return parts


def _grow(state: DataFrame, active: dict, chunk_size: int, n: int, bins: int, iteration: int) -> None:
    """Passes over the rows until every tree is done: about as many as the deepest tree has levels."""
    spark = state.sparkSession
    while True:
        wanted = {m: g.wanted() for m, g in active.items()}
        if not any(wanted.values()):
            return
        asked, back = {}, {}
        for m, leaves in wanted.items():
            if leaves:
                tree, place = active[m].shape()
                asked[m] = (active[m].candidate, tree, [place[i] for i in leaves])
                back |= {(*m, place[i]): i for i in leaves}
        shared = spark.sparkContext.broadcast((asked, chunk_size, n, bins, iteration))
        sums = state.where(f"role = {TRAIN}").select("fold", "chunk", "n", "u", "y", "w", "x", "scores").mapInArrow(_histograms(shared), "fold string, number int, leaf int, sums binary")
        found = sums.repartition(min(len(back), spark.sparkContext.defaultParallelism), "fold", "number", "leaf").mapInArrow(_splits(shared), _SPLIT).collect()
        for r in found:
            node = active[r["fold"], r["number"]].nodes[back.pop((r["fold"], r["number"], r["leaf"]))]
            node.sums = node.sums or (r["g"], r["h"], r["n"])
            node.split = (r["feature"], r["bin"], r["gain"], (r["lg"], r["lh"], r["ln"])) if r["feature"] is not None else False
        for fold, number, leaf in back:  # leaves without rows that the tree sees
            node = active[fold, number].nodes[back[fold, number, leaf]]
            node.sums, node.split = node.sums or (0.0, 0.0, 0), False
        shared.unpersist()


def _rows(model: tuple[str, int], iteration: int, t: Tree, features: list[str], cuts: np.ndarray) -> list[tuple]:
    out = []
    for k in range(len(t.feature)):
        leaf = t.feature[k] < 0
        split = (None, None, None, None, None, None) if leaf else (features[t.feature[k]], int(t.bin[k]), float(cuts[t.feature[k], t.bin[k]]), float(t.gain[k]), int(t.left[k]), int(t.right[k]))
        out.append((*model, iteration, k, *split, float(t.value[k]) if leaf else None, int(t.rows[k])))
    return out


def best_rounds(rounds: DataFrame) -> DataFrame:
    """Per fold and candidate the round of highest mean validation rank IC as ``best_iteration``, the earliest of equals; without any the last."""
    order = Window.partitionBy("fold", "candidate_id").orderBy(F.desc_nulls_last("mean_rank_ic"), F.when(F.col("mean_rank_ic").isNull(), -F.col("iteration")).otherwise(F.col("iteration")))
    return rounds.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r").withColumnRenamed("iteration", "best_iteration")


def upto(trees: DataFrame, chosen: DataFrame) -> DataFrame:
    """Nodes of the chosen ``fold, candidate_id`` up to their ``best_iteration``.

    A tree depends on train rows, parameters and the number of its round alone: these are the trees that fitting the
    chosen parameters anew for so many rounds gives.
    """
    return trees.join(F.broadcast(chosen.select("fold", "candidate_id", "best_iteration")), ["fold", "candidate_id"]).where("iteration <= best_iteration").drop("best_iteration")


def _packed(nodes: list) -> dict:
    by: dict = {}
    for r in nodes:
        by.setdefault(r["fold"], {}).setdefault((r["candidate_id"], r["iteration"]), []).append(r)
    return by


def predict(rows: DataFrame, trees: DataFrame, features: list[str], cuts: np.ndarray, by: str = "fold") -> DataFrame:
    """``rows`` without the features (or their ``x``), with ``score``: the sum of a fold's trees, of one candidate a fold; NULL for a fold without any.

    The trees, some thousand nodes a fold, are broadcast.
    """
    place = {f: k for k, f in enumerate(features)}
    built = {}
    for fold, own in _packed(trees.orderBy("iteration", "node").collect()).items():
        if len({c for c, _ in own}) > 1:
            raise ContractError(f"{fold} has trees of more than one candidate")
        built[fold] = [_tree(nodes, place) for _, nodes in sorted(own.items())]
    shared = rows.sparkSession.sparkContext.broadcast(built)
    table = _ready(rows, features, cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold = np.array([str(f) for f in batch.column(by).to_pylist()], object)
            x = np.frombuffer(b"".join(batch.column("x").to_pylist()), np.uint8).reshape(batch.num_rows, len(features))
            score = np.full(batch.num_rows, np.nan)
            for f, own in shared.value.items():
                at = np.flatnonzero(fold == f)
                score[at] = sum((t.value[t.leaf_of(x[at])] for t in own), np.zeros(len(at)))
            kept = [n for n in batch.schema.names if n != "x"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(score, from_pandas=True)], names=[*kept, "score"])

    rest = [c for c in table.columns if c != "x"]
    return table.mapInArrow(run, ", ".join([*(f"`{c}` {t}" for c, t in table.select(*rest).dtypes), "score double"]))


def _tree(nodes: list, place: dict) -> Tree:
    pick = lambda c, none: np.array([none if r[c] is None else r[c] for r in nodes])
    feature = np.array([-1 if r["feature"] is None else place[r["feature"]] for r in nodes])
    return Tree(feature, pick("bin", 0), pick("left", -1), pick("right", -1), pick("value", 0.0).astype(float), pick("gain", 0.0), pick("n_rows", 0))


def importances(trees: DataFrame, features: list[str]) -> DataFrame:
    """``fold, candidate_id, feature, gain_importance, split_importance``: gains and splits added up by feature, 0 where it never splits."""
    split = trees.where("feature is not null").groupBy("fold", "candidate_id", "feature").agg(F.sum("gain").alias("gain_importance"), F.count("*").alias("split_importance"))
    every = trees.select("fold", "candidate_id").distinct().select("*", F.explode(F.array(*map(F.lit, features))).alias("feature"))
    zero = {"gain_importance": 0.0, "split_importance": 0}
    return every.join(split, ["fold", "candidate_id", "feature"], "left").fillna(zero)
