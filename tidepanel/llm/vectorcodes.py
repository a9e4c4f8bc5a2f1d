"""Operator 13: vector code compression by product quantisation over lexicographic tries.

Vectors of integers are cut into parts.  Equal parts of one position are one row with a count, kept in
lexicographic order: each task then holds a run of leaves of that position's trie.  A depth-first walk carries,
for every prefix of components, the vector of squared distances to all codebook entries summed over that prefix;
parts that begin alike share it.  At a leaf its least distance is the entry, and count times part goes to the
entry's sums.  A round moves parts x entries x components numbers at most to the driver, whatever the number of rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.store import discard, written

#: Trie nodes of one depth that are walked together.
BLOCK = 1024


@dataclass(frozen=True)
class Codebooks:
    """``entries[part]``: an integer matrix, a row per entry; ``dims``: components of a vector."""

    entries: tuple[np.ndarray, ...]
    dims: int

    def sha256(self) -> str:
        """Lowercase hex of all components in decimal by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(x) for book in self.entries for x in book.reshape(-1).tolist()).encode()).hexdigest()


def bound(dims: int) -> int:
    """Components beyond +-``bound`` are moved to it, so that squared distances of whole vectors fit 64 bits: 2 ** 27 for 64 of them."""
    return 1 << (min(60, (62 - max(1, dims - 1).bit_length()) // 2) - 1)


def integers(vector: Column, scale: int) -> Column:
    """Components times ``scale``, as double, rounded down; null if the vector is null or holds null, NaN or an infinity."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))))


def _first_change(rows: np.ndarray) -> np.ndarray:
    """For each of the sorted distinct rows the first component that differs from the row before; 0 for the first."""
    return np.concatenate([np.zeros(min(1, len(rows)), np.int64), (rows[1:] != rows[:-1]).argmax(1)])


def nearest(rows: np.ndarray, book: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry and squared distance of each row; ``rows`` are distinct and in lexicographic order, ties go to the lower entry.

    Depth first over the rows' trie, ``block`` sibling nodes at once: the stack holds at most one block of summed distances
    for each depth, and sums of a prefix are computed once for all rows below it.
    """
    n, depth = rows.shape
    entry, error = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if not depth:
        return entry, error
    most = int(max(np.abs(rows).max(initial=0), np.abs(book).max(initial=0)))
    kind = np.float64 if depth * (2 * most) ** 2 < 1 << 53 else np.int64  # both exact
    rows, book, fresh = rows.astype(kind), np.ascontiguousarray(book.T.astype(kind)), _first_change(rows)
    # a frame: depth, first rows of its nodes, row after the last, sums of the nodes one depth above, each node's parent
    stack = [(0, np.zeros(min(n, 1), np.int64), n, np.zeros((1, book.shape[1]), kind), np.zeros(min(n, 1), np.int64))]
    while stack:
        d, at, end, above, parent = stack.pop()
        if not len(at):
            continue
        sums = above[parent]
        if d:
            sums += (rows[at, d - 1][:, None] - book[d - 1]) ** 2
        if len(at) == end - at[0]:  # every node is a single row: nothing below is shared
            for c in range(d, depth):
                sums += (rows[at, c][:, None] - book[c]) ** 2
            d = depth
        if d == depth:
            best = sums.argmin(1)
            entry[at], error[at] = best, sums[np.arange(len(at)), best].astype(np.int64)
            continue
        child = at[0] + np.flatnonzero(fresh[at[0] : end] < d + 1)
        owner = np.searchsorted(at, child, "right") - 1
        for i in reversed(range(0, len(child), block)):
            j = i + block
            stack.append((d + 1, child[i:j], int(child[j]) if j < len(child) else end, sums, owner[i:j]))
    return entry, error


def _sorted_distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in lexicographic order, and the place of each row among them."""
    if not len(rows) or not rows.shape[1]:
        return rows[: min(1, len(rows))], np.zeros(len(rows), np.int64)
    order = np.lexsort(rows.T[::-1])
    s = rows[order]
    new = np.concatenate([[True], (s[1:] != s[:-1]).any(1)])
    back = np.empty(len(rows), np.int64)
    back[order] = np.cumsum(new) - 1
    return s[new], back


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width).astype(np.int64)


def _sums(books):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = books.value
        total = [np.zeros(b.shape, np.int64) for b in own]
        count = [np.zeros(len(b), np.int64) for b in own]
        for batch in batches:
            position, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("position", "n"))
            for p in np.unique(position):
                of = np.flatnonzero(position == p)
                rows = _matrix(batch.column("part").take(pa.array(of)), own[p].shape[1])
                rows, back = _sorted_distinct(rows)
                weight = np.zeros(len(rows), np.int64)
                np.add.at(weight, back, n[of])
                entry, _ = nearest(rows, own[p])
                np.add.at(total[p], entry, rows * weight[:, None])
                np.add.at(count[p], entry, weight)
        for p, (s, c) in enumerate(zip(total, count, strict=True)):
            used = np.flatnonzero(c)
            if len(used):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), p, np.int32)), pa.array(used.astype(np.int32)), pa.array(c[used]), pa.array(s[used].tolist(), pa.list_(pa.int64()))], names=["position", "entry", "n", "total"])

    return run


def _codes(books, dims: int):
    width = -(-dims // max(1, len(books.value)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            whole = _matrix(batch.column("vector"), dims)
            code, error = np.zeros((n, len(books.value)), np.uint8), np.zeros(n, np.int64)
            for p, book in enumerate(books.value):
                rows, back = _sorted_distinct(whole[:, p * width : (p + 1) * width])
                entry, off = nearest(rows, book)
                code[:, p], error = entry[back], error + off[back]
            text = [x.tobytes().hex() for x in code]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "label")), pa.array(text, pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return run


def fit(vectors: DataFrame, dims: int, parts: int = 4, entries: int = 256, rounds: int = 4) -> Codebooks:
    """Codebooks of ``vectors(vec_id, vector)``: from the smallest ids, then ``rounds`` of assignment and rounded-down means.

    Part lengths are ceil(dims / parts), the last ones shorter if they don't come out even.  Entries start as the parts of the ``entries``
    smallest ids (nulls last, equal ids by vector); entries without parts stay as they are.  All rows count, equal ones each.
    """
    sc, width = vectors.sparkSession.sparkContext, -(-dims // parts)
    head = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    whole = np.array([r["vector"] for r in head], np.int64).reshape(len(head), dims)
    books = [whole[:, p * width : (p + 1) * width] for p in range(parts)]
    cut = F.array(*(F.slice("vector", F.lit(1 + p * width), F.lit(width)) for p in range(parts)))
    counted = written(vectors.select(F.posexplode(cut).alias("position", "part")).groupBy("position", "part").agg(F.count("*").alias("n")), "parts")
    leaves = written(counted.repartitionByRange("position", "part").sortWithinPartitions("position", "part"), "leaves")
    discard(counted)
    for _ in range(rounds):
        shared = sc.broadcast(books)
        found = leaves.mapInArrow(_sums(shared), "position int, entry int, n long, total array<long>")
        each = found.select("position", "entry", "n", F.posexplode_outer("total").alias("at", "x"))
        table = each.groupBy("position", "entry", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect()
        books = [b.copy() for b in books]
        for r in table:
            if r["at"] is not None:
                books[r["position"]][r["entry"], r["at"]] = r["x"] // r["n"]
        shared.unpersist()
    discard(leaves)
    return Codebooks(tuple(books), dims)


def encode(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """``vectors(vec_id, label, vector)`` to ``vec_id, label, code, error``: entry numbers as two hex digits a part, summed squared distances."""
    shared = vectors.sparkSession.sparkContext.broadcast(list(books.entries))
    kinds = dict(vectors.dtypes)
    return vectors.mapInArrow(_codes(shared, books.dims), f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def decode(codes: DataFrame, books: Codebooks) -> DataFrame:
    """``codes`` with ``vector``, the integer vector that ``code`` stands for; null where the code is."""
    tables = [F.lit(b.tolist()) if b.size else F.array(*[F.array().cast("array<int>")] * max(1, len(b))) for b in books.entries]
    pick = [F.element_at(t, F.conv(F.substring("code", 1 + 2 * p, 2), 16, 10).cast("int") + 1) for p, t in enumerate(tables)]
    return codes.withColumn("vector", F.when(F.col("code").isNotNull(), F.concat(*pick)))


def compress(rows: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, Codebooks]:
    """``vec_id, label, code, error, label_error`` for each vector, and the codebooks.

    Rows whose vector is null or holds a null or non-finite component take no part.  Vectors have the length of the one of the
    smallest kept id; others get a null code and error and bear on nothing.  Components beyond ``bound`` count as ``bound``.  Repeated rows
    count each; null ids come last; null labels are a label of their own; other columns are ignored; an empty table gives an empty one.
    ``label_error`` is the sum of ``error`` over a label (null if none of its rows has one).
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    whole = integers(F.col(vector_col), scale)
    kept = rows.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), whole.alias("wide")).where("wide is not null")
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "wide").select(F.size("wide")).first()
    dims = first[0] if first else 0
    top = bound(dims)
    limited = F.transform("wide", lambda x: F.greatest(F.least(x, F.lit(top)), F.lit(-top)).cast("int"))
    stored = written(kept.select("vec_id", "label", limited.alias("vector")), "vectors")
    fits = F.size("vector") == dims
    books = fit(stored.where(fits), dims, parts, entries, rounds)
    other = stored.where(~fits).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    coded = written(encode(stored.where(fits), books).unionByName(other), "codes")
    discard(stored)
    summed = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    # a row per label: Spark broadcasts it if it is small, else it splits hot labels of the join
    return coded.join(summed, F.col("label").eqNullSafe(F.col("_label"))).drop("_label"), books
