"""Operator 6: removal of repeated word windows, found by level-wise doubling.

Level 1 takes, of each text's runs of ``levels[0]`` words, those whose hash is the
smallest of some full-length window; two equal windows choose the same run, so none is
lost and only a few positions in a hundred move.  Runs that occur in one text alone end
there.  Survivors are extended to about twice the length, and those that repeat again to
the full window.  Only then are all full windows around survivors compared.

Texts that are equal as a whole fold into one class first: every copy but the one of
the smallest id is covered entirely, so large groups of copies cost one text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm import textcodes as tc
from tidepanel.llm.store import discard, prompt_cleanup, small_batches, written

EMPTY = hashlib.sha256(b"").hexdigest()


def _reduced(x: np.ndarray, n: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over each run of n values."""
    out, have = x, 1
    while have < n:
        step = min(have, n - have)
        out = pick(out[: len(out) - step], out[step:])
        have += step
    return out


def anchors(words: tc.Words, short: np.ndarray, window: int, level: int) -> np.ndarray:
    """Word positions whose run of ``level`` words has the smallest hash of a window of ``window`` words."""
    starts, _ = tc.run_starts(words.first, words.counts, window)
    span = window - level + 1
    if not len(starts):
        return starts
    least = np.zeros(len(short), np.uint64)
    least[starts] = _reduced(short, span, np.minimum)[starts]
    padded = np.concatenate([np.zeros(span - 1, np.uint64), least])
    best = _reduced(padded, span, np.maximum)
    return np.flatnonzero((best == short) & (best > 0))


def _read(window: int, level: int, double: int):
    """Per text its word count, the digest of its words and its anchors, all from one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tc.slices(batches):
            n, sha = [], []
            for text in batch.column("text"):
                words = (text.as_py() or "").encode().split()
                n.append(len(words))
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
                del words
            data, offsets = tc.buffers(batch.column("text"))
            counts, found = [np.zeros(1, np.int64)], []
            for i, j, part, offs in tc.chunked(data, offsets):
                words = tc.Words(part, offs, tc.SPACES)
                made = tc.grams(words.hashes(), [level, double])
                at = anchors(words, made[level], window, level)
                text = np.searchsorted(words.first, at, "right") - 1
                counts.append(np.bincount(text, minlength=j - i))
                last = len(made[double]) - 1
                right = made[double][np.minimum(at, last)] if last >= 0 else at.astype(np.uint64)
                left = made[double][np.clip(at - (double - level), 0, last)] if last >= 0 else at.astype(np.uint64)
                found.append(((at - words.first[text]).astype(np.int32), tc.signed(made[level][at]), tc.signed(right), tc.signed(left)))
            columns = [pa.array(np.concatenate(c)) for c in zip(*found, strict=True)]
            runs = pa.StructArray.from_arrays(columns, names=["pos", "h", "right", "left"])
            runs = pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(counts)).astype(np.int32)), runs)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("t1"), batch.column("t2"), pa.array(n, pa.int64()), pa.array(sha, pa.string()), runs],
                names=["doc_id", "t1", "t2", "n_words", "sha", "runs"],
            )

    return run


def _windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tc.slices(batches):
            data, offsets = tc.buffers(batch.column("text"))
            ids, t1 = batch.column("rep"), batch.column("t1")
            spans = [s.as_py() for s in batch.column("spans")]
            for i, j, part, offs in tc.chunked(data, offsets):
                words = tc.Words(part, offs, tc.SPACES)
                h = words.hashes()
                full = tc.grams(h, [window])[window]
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tc.mix(h + np.uint64(77)))])
                if not len(full):
                    continue
                change = np.zeros(len(h) + 1, np.int64)
                for k in range(i, j):
                    most = words.counts[k - i] - window
                    for s in spans[k]:
                        lo, hi = max(0, s["lo"]), min(most, s["hi"])
                        if lo <= hi:
                            change[words.first[k - i] + lo] += 1
                            change[words.first[k - i] + hi + 1] -= 1
                at = np.flatnonzero(np.cumsum(change)[: len(full)])
                text = np.searchsorted(words.first, at, "right") - 1
                other = (tc.mix(sums[at + window] - sums[at]) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                take = pa.array(i + text)
                yield pa.RecordBatch.from_arrays([ids.take(take), t1.take(take), pa.array((at - words.first[text]).astype(np.int32)), pa.array(tc.signed(full[at])), pa.array(other)], names=["rep", "t1", "pos", "h", "h2"])

    return run


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tc.slices(batches):
            removed, sha = [], []
            for text, starts in zip(batch.column("text"), batch.column("starts"), strict=True):
                words = text.as_py().encode().split()
                change = np.zeros(len(words) + 1, np.int64)
                at = np.asarray(starts.values.to_numpy(zero_copy_only=False))
                np.add.at(change, at, 1)
                np.add.at(change, at + window, -1)
                gone = np.cumsum(change)[:-1] > 0
                removed.append(int(gone.sum()))
                sha.append(hashlib.sha256(b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("t1"), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], names=["rep", "t1", "n_cut", "sha_cut"])

    return run


def _repeated(rows: DataFrame, key: str) -> DataFrame:
    """Rows whose hash occurs in two different texts.

    The repeated hashes are stored first: then a join has nothing but shuffled tables on both
    sides, and Spark splits the rows of a very common hash over many tasks.
    """
    seen = written(rows.groupBy(key).agg(F.min("t1").alias("lo"), F.max("t1").alias("hi")).where("lo < hi").select(key), "repeated")
    return rows.join(seen.hint("merge"), key, "left_semi")


def repeated_windows(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Tables behind the removal: per-row word counts, smallest id of equal texts, flagged window starts, candidate texts.

    A flagged start begins a window whose word sequence also starts in a smaller id.
    """
    small_batches(docs.sparkSession)
    prompt_cleanup(docs.sparkSession)
    level, double = max(1, (window + 3) // 4), max(1, window // 2)
    text = F.col(text_col)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("t1"), F.hash(text).alias("t2"))
    kind = "doc_id long, t1 long, t2 int, n_words long, sha string, runs array<struct<pos:int,h:long,right:long,left:long>>"
    both = written(base.mapInArrow(_read(window, level, double), kind), "read")
    counted = both.drop("runs")
    reps = written(counted.where(f"n_words >= {window} and doc_id is not null").groupBy("t1", "t2").agg(F.min("doc_id").alias("rep")), "reps")

    runs = both.where("doc_id is not null").select("doc_id", "t1", F.explode("runs").alias("r")).select("doc_id", "t1", "r.*")
    first = written(_repeated(runs, "h"), "level1")
    half = window - double
    sides = F.array(
        F.struct(F.col("right").alias("h"), (F.col("pos") - half).alias("lo"), F.col("pos").alias("hi")),
        F.struct(F.col("left").alias("h"), (F.col("pos") - (window - level)).alias("lo"), (F.col("pos") - half - 1).alias("hi")),
    )
    second = _repeated(first.select("doc_id", "t1", F.explode(sides).alias("s")).select("doc_id", "t1", "s.*"), "h")
    spans = second.select("doc_id", "t1", "lo", "hi").distinct().groupBy("doc_id", "t1").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    spans = spans.join(reps, "t1").where("doc_id = rep").select("rep", "t1", "t2", "spans")
    texts = base.select(F.col("doc_id").alias("rep"), "t1", "t2", "text")
    candidates = written(texts.join(spans.hint("merge"), ["rep", "t1", "t2"]), "candidates")
    discard(first)

    rows = written(candidates.mapInArrow(_windows(window), "rep long, t1 long, pos int, h long, h2 int"), "windows")
    least = written(rows.groupBy("h", "h2").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select("h", "h2", "lo"), "least")
    flagged = rows.join(least.hint("merge"), ["h", "h2"]).where("rep > lo").select("rep", "t1", "pos")
    return counted, reps, flagged, candidates.select("rep", "t1", "text")


def substring_dedup(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_removed, kept_sha256``.

    Words are runs of non-space, unchanged.  A word goes if a window of ``window`` words
    over it also starts in a document of a smaller id, judged on the input.  Repeats
    inside one document stay.  Null texts have no words.  A null id takes no part and
    loses nothing.  Repeated rows get the same result each; extra columns are ignored;
    an empty table gives an empty one.
    """
    counted, reps, flagged, texts = repeated_windows(docs, window, id_col, text_col)
    starts = flagged.groupBy("rep", "t1").agg(F.collect_set("pos").alias("starts"))
    cut = texts.dropDuplicates(["rep", "t1"]).join(starts.hint("merge"), ["rep", "t1"]).mapInArrow(_cut(window), "rep long, t1 long, n_cut long, sha_cut string")
    able = F.coalesce((F.col("n_words") >= window) & F.col("doc_id").isNotNull(), F.lit(False))
    # Short texts and null ids go past the joins, where they would share keys; copies of one text are split by Spark.
    out = counted.where(able).join(reps.hint("merge"), ["t1", "t2"]).join(written(cut, "cut").hint("merge"), ["rep", "t1"], "left")
    copy = F.col("doc_id") > F.col("rep")
    rest = counted.where(~able).select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256"))
    return rest.unionByName(out.select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_cut", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(EMPTY)).otherwise(F.coalesce("sha_cut", "sha")).alias("kept_sha256"),
    ))
