"""Operator 8: benchmark decontamination over a distributed positional inverted index.

``build_index`` stores postings of the training tokens that test items ask for (postings of other
terms could never be read): each row is a block of texts with, for every term, the ascending positions at which it stands.  Blocks are dealt by document,
so a very common term or passage spreads over all of them and a search needs no shuffle.
``search`` takes windows of test words in blocks of a checked size, ranks each window's
terms by their postings in the whole corpus, starts from the rarest list and intersects
it with the other lists moved by their offsets, until no candidate is left or all terms agree.
Positions are 64-bit term hashes away from the words themselves; a window is a phrase match
only if all of its terms agree.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm import textcodes as tc
from tidepanel.llm.store import discard, small_batches, written

INDEX = "block string, ids array<long>, first array<int>, terms array<long>, lists array<int>, postings binary"
#: Test windows searched at once; more are searched in further rounds.
WINDOWS_AT_ONCE = 200_000
#: Different terms of test windows that one index covers: 32 MB of hashes.
TERMS_AT_ONCE = 4_000_000


def _indexed(vocabulary, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = vocabulary.value
        for batch in tc.slices(batches):
            data, offsets = tc.buffers(batch.column("text"))
            ids = batch.column("doc_id")
            for i, j, part, offs in tc.chunked(data, offsets, size):
                words = tc.Words(part, offs, tc.NOT_WORD)
                h = words.hashes(tc.FOLDED_CODES)
                term = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
                at = np.flatnonzero(wanted[term] == h)
                term = term[at]
                order = np.argsort(term, kind="stable")
                present, lists = np.unique(term[order], return_index=True)
                ends = np.append(lists, len(order)).astype(np.int32)
                row = [uuid.uuid4().hex, ids.slice(i, j - i).to_pylist(), words.first.astype(np.int32), tc.signed(wanted[present]), ends, at[order].astype(np.int32).tobytes()]
                kinds = (pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=["block", "ids", "first", "terms", "lists", "postings"])

    return run


def build_index(docs: DataFrame, vocabulary: np.ndarray, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 1 << 21) -> DataFrame:
    """Store postings of the terms whose hashes ``vocabulary`` lists, in blocks of about ``block_bytes`` of text.

    Words are runs of digits, letters and non-ASCII, A-Z lowered.  Null texts have no words.
    """
    spark = docs.sparkSession
    small_batches(spark)
    wanted = spark.sparkContext.broadcast(np.unique(np.append(vocabulary, np.uint64(0))))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return written(texts.mapInArrow(_indexed(wanted, block_bytes), INDEX), "index")


def _item_windows(n: int):
    """Per item and window: item, place in it, hash, and the terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tc.buffers(batch.column("text"))
            ids = batch.column("item_id")
            for i, j, part, offs in tc.chunked(data, offsets):
                words = tc.Words(part, offs, tc.NOT_WORD)
                h = words.hashes(tc.FOLDED_CODES)
                item, terms = [], []
                for k in range(j - i):
                    own = tc.signed(h[words.first[k] : words.first[k + 1]])
                    for s in range(max(1, len(own) - n + 1) if len(own) else 0):
                        item.append(i + k)
                        terms.append(own[s : s + n])
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(item, pa.int64())), pa.array(terms, pa.list_(pa.int64()))], names=["item_id", "terms"])

    return run


def phrase_windows(items: DataFrame, n: int = 13, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``terms, item_ids``: each distinct window of n words (a shorter item is one) and the items it is in."""
    rows = items.select(F.col(id_col).cast("string").alias("item_id"), F.col(text_col).alias("text")).where("item_id is not null")
    return rows.mapInArrow(_item_windows(n), "item_id string, terms array<long>").groupBy("terms").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))


class _Queries:
    """Windows of one length, with their numbers, as a matrix of places in the vocabulary, rarest term first in ``order``."""

    def __init__(self, terms: np.ndarray, numbers: np.ndarray, vocabulary: np.ndarray, df: np.ndarray):
        self.n, self.numbers = terms.shape[1], numbers
        self.places = np.searchsorted(vocabulary, terms.view(np.uint64))
        self.order = np.argsort(df[self.places], axis=1, kind="stable")


def _matches(q: _Queries, lists: np.ndarray, ends: np.ndarray, postings: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows and start positions of phrase matches in one block.

    ``keys`` holds (term, position) in ascending order; a list moved by its offset is asked
    for by binary search, rarest list first.
    """
    many = ends - lists
    alive = np.flatnonzero(many[q.places].min(axis=1) > 0)
    if not len(alive):
        return alive, alive
    width = np.int64(n_words + q.n + 1)
    keys = np.repeat(np.arange(len(many), dtype=np.int64), many) * width + postings
    rarest = q.order[alive, 0]
    places = q.places[alive, rarest]
    size = many[places]
    window = np.repeat(alive, size)
    within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    start = postings[np.repeat(lists[places], size) + within] - np.repeat(rarest, size)
    for k in range(1, q.n):
        if not len(window):
            break
        offset = q.order[window, k]
        key = q.places[window, offset] * width + start + offset
        keep = (start >= 0) & (keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] == key)
        window, start = window[keep], start[keep]
    keep = start >= 0
    return window[keep], start[keep]


def _near(q: _Queries, lists: np.ndarray, ends: np.ndarray, postings: np.ndarray, first: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows, and the texts that have a stretch of at most n + slop words with every term as often as the window has it.

    Such a stretch holds the rarest term, so it lies around one of its places; places without all terms in reach fall out list by
    list, and at those that stay every stretch around them is counted.
    """
    n_words, many, span = int(first[-1]), ends - lists, q.n + slop
    alive = np.flatnonzero(many[q.places].min(axis=1) > 0)
    width = np.int64(n_words + 1)
    keys = np.repeat(np.arange(len(many), dtype=np.int64), many) * width + postings
    places = q.places[alive, q.order[alive, 0]]
    size = many[places]
    window = np.repeat(alive, size)
    at = postings[np.repeat(lists[places], size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)]
    text = np.searchsorted(first, at, "right") - 1
    low, high = np.maximum(at - span + 1, first[text]), np.minimum(at + span - 1, first[text + 1] - 1)
    for k in range(1, q.n):
        if not len(window):
            break
        base = q.places[window, q.order[window, k]] * width
        found = np.searchsorted(keys, base + low)
        keep = (found < len(keys)) & (keys[np.minimum(found, len(keys) - 1)] <= base + high)
        window, text, at, low, high = window[keep], text[keep], at[keep], low[keep], high[keep]
    hits = []
    for i in range(0, len(window), 4096):
        own = slice(i, i + 4096)
        terms = q.places[window[own]]
        need = (terms[:, :, None] == terms[:, None, :]).sum(2)
        one = np.repeat(np.arange(len(terms)), span)
        start = (at[own, None] - np.arange(span)).reshape(-1)
        for k in range(q.n):
            base, t = terms[one, k] * width, text[own][one]
            count = np.searchsorted(keys, base + np.minimum(start + span, first[t + 1])) - np.searchsorted(keys, base + np.maximum(start, first[t]))
            keep = count >= need[one, k]
            one, start = one[keep], start[keep]
        hits.append(i + np.unique(one))
    hit = np.concatenate(hits) if hits else np.zeros(0, np.int64)
    return window[hit], text[hit]


def _searched(asked, slop: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests, wanted, df = asked.value
        queries = [_Queries(terms, numbers, wanted, df) for terms, numbers in tests]
        for batch in batches:
            for block in batch.to_pylist():
                first = np.asarray(block["first"], np.int64)
                post = np.frombuffer(block["postings"], np.int32).astype(np.int64)
                lists, ends = np.zeros(len(wanted), np.int64), np.zeros(len(wanted), np.int64)
                terms = np.asarray(block["terms"], np.int64).view(np.uint64)
                have = np.minimum(np.searchsorted(wanted, terms), len(wanted) - 1)
                own = wanted[have] == terms  # the index may hold terms of other rounds
                bounds = np.asarray(block["lists"], np.int64)
                post = post[np.repeat(own, np.diff(bounds))]
                size = np.diff(bounds)[own]
                lists[have[own]], ends[have[own]] = np.cumsum(size) - size, np.cumsum(size)
                n_words = int(first[-1])
                change, exact, near = np.zeros(n_words + 1, np.int64), {}, {}
                for q in queries:
                    window, start = _matches(q, lists, ends, post, n_words)
                    text = np.searchsorted(first, start, "right") - 1
                    inside = start + q.n <= first[text + 1] if len(start) else start > 0
                    window, start, text = window[inside], start[inside], text[inside]
                    np.add.at(change, start, 1)
                    np.add.at(change, start + q.n, -1)
                    for t, w in zip(text.tolist(), q.numbers[window].tolist(), strict=True):
                        exact.setdefault(t, set()).add(w)
                    if slop >= 0:
                        window, text = _near(q, lists, ends, post, first, slop)
                        for t, w in zip(text.tolist(), q.numbers[window].tolist(), strict=True):
                            near.setdefault(t, set()).add(w)
                cover = np.cumsum(change)[:-1] > 0
                edge = np.diff(np.concatenate([[False], cover, [False]]).astype(np.int8))
                runs: dict[int, list] = {}
                for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
                    t = int(np.searchsorted(first, a, "right")) - 1
                    while a < b:  # a run may go on over the end of a text
                        stop = min(b, int(first[t + 1]))
                        if a < stop:
                            runs.setdefault(t, []).append({"lo": int(a - first[t]), "hi": int(stop - first[t])})
                        a, t = stop, t + 1
                k = range(len(block["ids"]))
                columns = [
                    pa.array([f"{block['block']}-{t}" for t in k], pa.string()),
                    pa.array(block["ids"], pa.int64()),
                    pa.array(np.diff(first)),
                    pa.array([runs.get(t, []) for t in k], _RUNS),
                    pa.array([sorted(exact.get(t, ())) for t in k], pa.list_(pa.int64())),
                    pa.array([sorted(near.get(t, ())) for t in k], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "n_words", "runs", "exact", "near"])

    return run


_RUNS = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
FOUND = "row string, doc_id long, n_words long, runs array<struct<lo:long,hi:long>>, exact array<long>, near array<long>"


def _vocabulary(windows: DataFrame) -> np.ndarray:
    found = windows.select(F.explode("terms").alias("t")).distinct().toPandas()["t"].to_numpy(np.int64)
    return np.unique(np.append(found.view(np.uint64), np.uint64(0)))


def _round(index: DataFrame, windows: DataFrame, slop: int) -> DataFrame:
    """What one round's windows find in a stored index."""
    vocabulary = _vocabulary(windows)
    size = F.arrays_zip("terms", F.transform(F.slice("lists", 2, F.size("terms")), lambda x, i: x - F.get("lists", i)).alias("n"))
    terms = windows.select(F.explode("terms").alias("terms")).distinct()
    df = index.select(F.explode(size).alias("z")).groupBy("z.terms").agg(F.sum("z.n").alias("n")).join(terms, "terms", "left_semi").toPandas()
    total = np.zeros(len(vocabulary), np.int64)
    total[np.searchsorted(vocabulary, df["terms"].to_numpy(np.int64).view(np.uint64))] = df["n"].to_numpy(np.int64)
    by_length: dict[int, tuple[list, list]] = {}
    for terms, number in windows.select("terms", "number").collect():
        have = by_length.setdefault(len(terms), ([], []))
        have[0].append(terms)
        have[1].append(number)
    made = [(np.asarray(t, np.int64), np.asarray(i, np.int64)) for t, i in by_length.values()]
    context = index.sparkSession.sparkContext
    return index.mapInArrow(_searched(context.broadcast((made, vocabulary, total)), slop), FOUND)


def _merged(runs):
    """Union of runs, ascending, without Python."""
    ordered = F.array_sort(runs)
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, r: F.struct(F.greatest(acc["end"], r["hi"]).alias("end"), (acc["n"] + F.greatest(r["hi"] - F.greatest(acc["end"], r["lo"]), F.lit(0).cast("long"))).alias("n"))
    return F.aggregate(ordered, zero, step)["n"]


def _named(hits: DataFrame, windows: DataFrame, sets: DataFrame) -> DataFrame:
    """``row, items, near_items``: the items behind the window numbers of rows that have some; no item list is broadcast.

    Windows of the same items share one number of their set, so a row meets each set of items once, as a list.
    """
    kind = lambda c, exact: F.transform(c, lambda w: F.struct(w.alias("number"), F.lit(exact).alias("is_exact")))
    asked = hits.select("row", F.explode(F.concat(kind("exact", True), kind("near", False))).alias("w")).select("row", "w.*")
    asked = asked.join(windows.select("number", "set").hint("merge"), "number").select("row", "set", "is_exact").distinct()
    named = asked.join(sets.hint("merge"), "set")
    ids = lambda exact: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("is_exact") == exact, F.col("item_ids"))))))
    return named.groupBy("row").agg(ids(True).alias("items"), ids(False).alias("near_items"))


def contamination(docs: DataFrame, items: DataFrame, n: int = 13, id_col: str = "doc_id", text_col: str = "text", slop: int = -1, at_once: int = WINDOWS_AT_ONCE, terms_at_once: int = TERMS_AT_ONCE) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_hit, items, near_items``.

    A word is hit if it stands inside an occurrence of a window of n item words; an item of
    fewer words is one window; an item or text without words (or null) has none.  With
    ``slop`` of 0 or more, ``near_items`` are the items of windows of which the text holds all terms, in any
    order and each as often as the window, inside one stretch of at most n + slop words (n: the window's own length).  That is a matter of the text
    alone.  The corpus is indexed once for all windows, which are searched ``at_once`` at a time, so what is broadcast is
    bounded: terms and numbers of windows; item ids are joined to the matches.  Windows of more than about ``terms_at_once`` different
    terms are indexed in several parts.  Repeated rows stay; null item ids take no part; extra columns are
    ignored; empty tables give no hits, or no rows.
    """
    plain = written(phrase_windows(items, n).withColumn("number", F.monotonically_increasing_id()), "windows")
    sets = written(plain.groupBy("item_ids").agg(F.min("number").alias("set")), "item-sets")
    windows = written(plain.join(sets, "item_ids").select("terms", "number", "set"), "phrases")
    discard(plain)
    many = windows.count()
    n_terms = windows.select(F.explode("terms").alias("t")).distinct().count()
    parts = max(1, -(-n_terms // terms_at_once))
    rounds = max(1, -(-many // (at_once * parts)))
    part = F.pmod(F.xxhash64("terms"), F.lit(parts * rounds))
    none = F.array().cast("array<string>")
    rows, key = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "doc_id"
    if parts > 1:  # rows of several indexes meet by a number of their own
        rows, key = written(rows.withColumn("own", F.monotonically_increasing_id()), "rows"), "own"
    found, indexes = [], []
    for p in range(parts):
        of_part = windows.where(F.pmod(part, F.lit(parts)) == p)
        index = build_index(rows, _vocabulary(of_part), key, "text")
        indexes.append(index)
        for k in range(rounds):
            hit = _round(index, windows.where(part == p + k * parts), slop)
            found.append(hit if parts == 1 else hit.withColumn("row", F.col("doc_id").cast("string")))
    both = found[0]
    for more in found[1:]:
        both = both.unionByName(more)
    if len(found) > 1:
        both = both.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), *(F.flatten(F.collect_list(c)).alias(c) for c in ("runs", "exact", "near")))
    if parts > 1:
        both = both.withColumnRenamed("doc_id", "own").join(rows.select("own", "doc_id"), "own").drop("own")
    found = written(both, "found")
    for index in indexes:
        discard(index)
    hit = (F.size("exact") > 0) | (F.size("near") > 0)
    hits = found.where(hit).join(_named(found.where(hit), windows, sets), "row", "left")
    every = hits.unionByName(found.where(~hit).select("*", none.alias("items"), none.alias("near_items")))
    return every.select("doc_id", "n_words", _merged(F.col("runs")).alias("n_hit"), "items", "near_items")


def contaminated(n_hit, n_words):
    """The rule: a hit, and hits that make at least a twentieth of the words."""
    return (n_hit > 0) & (20 * n_hit >= n_words)
