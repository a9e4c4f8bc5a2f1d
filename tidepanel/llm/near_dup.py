"""Operator 7: MinHash near-duplicates with sequential Bayesian verification.

Texts become sets of word shingles.  Exact copies of a set fold into one class, whose
smallest id stands for it.  Bands of MinHash values bring classes into buckets.  Each
bucket first compares every member with its smallest one; what that links is one
component already, so only members of *different* components of a bucket are compared
next: directly in small buckets, and in large ones block against block inside a task,
which returns a spanning forest of the links it confirmed.  A candidate's signatures are
compared in batches; it is dropped once the posterior probability that its similarity
reaches the threshold falls below ``miss`` over the number of batches.  Survivors are confirmed on their full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm import textcodes as tc
from tidepanel.llm.graph import components
from tidepanel.llm.sieve import sieve
from tidepanel.llm.store import small_batches, written


@dataclass(frozen=True)
class NearDup:
    """Parameters: similarity is ``percent``/100; ``rows`` MinHash values make one of ``bands`` bands."""

    shingle: int = 5
    percent: int = 80
    bands: int = 28
    rows: int = 4
    batch: int = 16
    miss: float = 1e-5
    small: int = 24
    block: int = 256

    @property
    def size(self) -> int:
        return self.bands * self.rows


def least_matches(p: NearDup) -> list[tuple[int, int]]:
    """(hashes compared, fewest equal ones with which a candidate goes on), per batch; ``miss`` is shared out over the batches.

    The prior is uniform; the posterior after m of n is Beta(m + 1, n - m + 1).
    """
    grid = (np.arange(20000) + 0.5) / 20000
    above = grid >= p.percent / 100
    out = []
    for n in range(p.batch, p.size + 1, p.batch):
        for m in range(n + 1):
            log = m * np.log(grid) + (n - m) * np.log1p(-grid)
            mass = np.exp(log - log.max())
            if mass[above].sum() / mass.sum() >= p.miss * p.batch / p.size:
                out.append((n, m))
                break
    return out


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes text by text (ascending in each), and their text numbers.

    A text with fewer than n words has its whole sequence as its only shingle; one
    without words has none.
    """
    words = tc.Words(data, offsets, tc.SPACES)
    h = words.hashes(tc.FOLDED_CODES)
    at, text = tc.run_starts(words.first, words.counts, n)
    runs = tc.grams(h, [n])[n]
    value = runs[at] if len(at) else np.zeros(0, np.uint64)
    short = np.flatnonzero((words.counts > 0) & (words.counts < n))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for length in range(1, n):
            pick = words.counts[short] == length
            if pick.any():
                whole[pick] = tc.grams(h, [length])[length][words.first[short[pick]]] ^ np.uint64(length)
        value, text = np.concatenate([value, whole]), np.concatenate([text, short])
    order = np.lexsort((value, text))
    value, text = value[order], text[order]
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    return value[keep], text[keep]


def _signatures(value: np.ndarray, text: np.ndarray, texts: int, p: NearDup) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Set sizes, the texts that have a set, and their MinHash values (others: zeros)."""
    seeds = tc.mix(np.arange(1, p.size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    n = np.bincount(text, minlength=texts)
    full = np.flatnonzero(n)
    sig = np.zeros((texts, p.size), np.uint32)
    if len(full):
        at = (np.cumsum(n) - n)[full]
        for k, seed in enumerate(seeds):
            x = value ^ seed
            x *= seed
            sig[full, k] = np.minimum.reduceat((x >> np.uint64(32)).astype(np.uint32), at)
    return n, full, sig


def _lists(rows: np.ndarray, bounds: np.ndarray | None = None) -> pa.ListArray:
    """Longs as lists: the rows of a matrix, or what lies between bounds."""
    if bounds is None:
        bounds = np.arange(len(rows) + 1) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(tc.signed(rows.reshape(-1))))


def _banded(p: NearDup):
    """Set size, two hashes of the set and the band keys of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tc.slices(batches):
            data, offsets = tc.buffers(batch.column("text"))
            ids = batch.column("doc_id")
            for i, j, part, offs in tc.chunked(data, offsets):
                value, text = shingle_sets(part, offs, p.shingle)
                n, full, sig = _signatures(value, text, j - i, p)
                h1, h2 = np.zeros(j - i, np.uint64), np.zeros(j - i, np.uint64)
                if len(full):
                    at = (np.cumsum(n) - n)[full]
                    h1[full] = np.add.reduceat(value, at)
                    h2[full] = np.add.reduceat(tc.mix(value.copy()), at)
                sig = sig.reshape(j - i, p.bands, p.rows)
                keys = np.zeros((j - i, p.bands), np.uint64) + np.arange(1, p.bands + 1, dtype=np.uint64)
                for r in range(p.rows):
                    keys = tc.joined(keys, sig[:, :, r].astype(np.uint64))
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(n.astype(np.int64)), pa.array(tc.signed(h1)), pa.array(tc.signed(h2)), _lists(keys)], names=["doc_id", "n_shingles", "h1", "h2", "keys"])

    return run


def _known(p: NearDup):
    """Signature and full set of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tc.slices(batches):
            data, offsets = tc.buffers(batch.column("text"))
            ids = batch.column("node")
            for i, j, part, offs in tc.chunked(data, offsets):
                value, text = shingle_sets(part, offs, p.shingle)
                _, _, sig = _signatures(value, text, j - i, p)
                bounds = np.searchsorted(text, np.arange(j - i + 1))
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array([x.tobytes() for x in sig], pa.binary()), _lists(value, bounds)], names=["node", "sig", "s"])

    return run


def _plausible(a: np.ndarray, b: np.ndarray, floor: list[tuple[int, int]]) -> np.ndarray:
    """Which rows of two signature matrices stay plausible, batch by batch."""
    alive, met, start = np.arange(len(a)), np.zeros(len(a), np.int64), 0
    for n, m in floor:
        met = met + (a[alive, start:n] == b[alive, start:n]).sum(1)
        keep = met >= m
        alive, met, start = alive[keep], met[keep], n
    return alive


def _pruned(p: NearDup):
    floor = least_matches(p)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            a, b = (np.frombuffer(b"".join(f[c]), np.uint32).reshape(len(f), p.size) for c in ("sa", "sb"))
            yield f.iloc[_plausible(a, b, floor)][["a", "b"]]

    return run


def _forest(p: NearDup):
    """Links of one block, or between two blocks, of a large bucket: a spanning forest of them."""
    floor = least_matches(p)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        f = f.drop_duplicates("node").sort_values("node")
        left, right = f["side"].isin((0, 2)).to_numpy(), f["side"].isin((1, 2)).to_numpy()
        sig = np.frombuffer(b"".join(f["sig"]), np.uint32).reshape(len(f), p.size)
        root = {c: c for c in f["component"]}

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        node, comp, sets = f["node"].to_numpy(), f["component"].to_numpy(), f["s"].tolist()
        found = []
        for i in np.flatnonzero(left):
            others = np.flatnonzero(right & (comp != comp[i]))
            if f["side"].iloc[0] == 2:
                others = others[others > i]
            if not len(others):
                continue
            near = others[_plausible(np.broadcast_to(sig[i], (len(others), p.size)), sig[others], floor)]
            for j in near:
                x, y = find(comp[i]), find(comp[j])
                if x == y:
                    continue
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * both >= p.percent * (len(sets[i]) + len(sets[j]) - both):
                    root[max(x, y)] = min(x, y)
                    found.append((min(node[i], node[j]), max(node[i], node[j])))
        return pd.DataFrame(found, columns=["a", "b"]) if found else none

    return run


def _confirmed(pairs: DataFrame, known: DataFrame, p: NearDup) -> DataFrame:
    """Pairs (a, b) that pass the signature test and then the test on full sets."""
    sig = known.select("node", "sig")
    asked = pairs.join(sig.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a").join(sig.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b")
    alive = written(asked.mapInPandas(_pruned(p), "a long, b long"), "alive")
    both = alive.join(known.select(F.col("node").alias("a"), F.col("s").alias("x")), "a").join(known.select(F.col("node").alias("b"), F.col("s").alias("y")), "b")
    both = both.select("a", "b", F.size("x").alias("nx"), F.size("y").alias("ny"), F.size(F.array_intersect("x", "y")).alias("n"))
    return both.where(100 * F.col("n") >= p.percent * (F.col("nx") + F.col("ny") - F.col("n"))).select("a", "b")


def near_duplicates(docs: DataFrame, params: NearDup = NearDup(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, kept``.

    Words are runs of non-space, A-Z lowered.  Null or wordless texts have no shingles and
    no links: they are their own component.  Rows that share an id are one document; repeated rows
    stay.  A row without an id takes no part: its component is null, and it is kept.  Extra columns are ignored.  An empty table gives an empty one.
    Links are confirmed on full sets; a pair is missed only where no band of it agrees
    or its signatures look implausible (both bounded by the parameters).
    """
    p = params
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text"))
    signed = written(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_banded(p), "doc_id long, n_shingles long, h1 long, h2 long, keys array<long>"), "signed")
    full = signed.where("n_shingles > 0 and doc_id is not null")
    nodes = written(full.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("node"), F.first("keys").alias("keys")), "nodes")
    banded = nodes.select("node", F.explode("keys").alias("key"))
    sizes = banded.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("hub")).where("n > 1")
    members = written(banded.join(sizes, "key"), "members")
    wanted = members.select("node").distinct()
    shared = texts.where(sieve(wanted, "node")(F.col("node"))).join(wanted.hint("merge"), "node", "left_semi")
    known = written(shared.mapInArrow(_known(p), "node long, sig binary, s array<long>"), "known")

    star = members.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    first = written(_confirmed(star, known, p), "star")
    reached = components(first, "first")
    placed = members.join(reached, "node", "left").select("key", "n", "node", F.coalesce("component", "node").alias("component"))
    split = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    rest = written(placed.join(split, "key", "left_semi"), "rest")

    few = rest.where(F.col("n") <= p.small)
    pairs = few.alias("l").join(few.alias("r"), "key").where("l.node < r.node and l.component <> r.component").select(F.col("l.node").alias("a"), F.col("r.node").alias("b")).distinct()
    links = first.unionByName(_confirmed(pairs.join(star, ["a", "b"], "left_anti"), known, p))
    links = links.unionByName(_large_buckets(rest.where(F.col("n") > p.small), known, p))

    final = components(links, "second")
    # Texts without a set or an id go past the join, where they would share one key; large classes are split by Spark, as nodes is a stored table.
    linked = full.join(nodes.select("h1", "h2", "n_shingles", "node").hint("merge"), ["h1", "h2", "n_shingles"], "left")
    linked = linked.join(final, "node", "left").select("doc_id", "n_shingles", F.coalesce("component", "node").alias("component_id"))
    alone = signed.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _large_buckets(rest: DataFrame, known: DataFrame, p: NearDup) -> DataFrame:
    """Links between members of different components, block against block."""
    blocks = F.ceil(F.col("n") / p.block).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    rows = rest.select("key", "node", "component", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    rows = rows.select("key", "node", "component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"))
    rows = rows.join(known, "node").select("key", "i", "j", "node", "component", "side", "sig", "s")
    return rows.groupBy("key", "i", "j").applyInPandas(_forest(p), "a long, b long")
