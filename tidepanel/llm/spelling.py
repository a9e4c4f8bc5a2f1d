"""Operator 11: spelling variants of a vocabulary, by Bloom-guided neighbourhoods.

Two words are near if one inserted, deleted or replaced code point makes one of the other.  Every word generates its
deletions and its replacements by larger letters: of two near words exactly one generates the other.  An edit's hash follows
from the word's prefix sums, so no edit is spelled out unless a Bloom filter lets it through.  The vocabulary's filters are
sharded by word length and blocked: one 64-bit block is read for each probe.  Filters go out in groups of bounded size, one
group after another; what they let through is joined with the vocabulary, which leaves exact neighbours alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm import textcodes as tc
from tidepanel.llm.store import discard, written

#: Filter size: bits for each word, bits set by each word in its 64-bit block, blocks that a shard has at least.
BITS, SET, LEAST_BLOCKS = 24, 5, 64
#: Letters that are probed at once.
CHUNK = 1 << 16
_PAGE = 512
_STEP = 0xD6E8FEB86659FD93
_BACK = np.uint64(pow(_STEP, -1, 1 << 64))
_LOW = 0xFFFF


def _patterns() -> np.ndarray:
    """``SET`` bits of 64, for each value of a hash's low 16 bits."""
    x = tc.mix(np.arange(1, _LOW + 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out = np.zeros(len(x), np.uint64)
    for k in range(SET):
        out |= np.uint64(1) << ((x >> np.uint64(6 * k)) & np.uint64(63))
    return out


_PATTERNS = _patterns()


def shard(length: np.ndarray) -> np.ndarray:
    """Shards are lengths; beyond 64 code points a shard takes all lengths up to the next power of two."""
    length = np.asarray(length, np.int64)
    return np.where(length <= 64, length, 64 + np.ceil(np.log2(np.maximum(length, 1))).astype(np.int64))


@dataclass(frozen=True)
class Filters:
    """A group of filters: ``base[shard, slice]`` is the first block of a filter here, or -1; ``blocks`` and ``slices`` are by shard."""

    base: np.ndarray
    blocks: np.ndarray
    slices: np.ndarray
    bits: np.ndarray

    def place(self, h: np.ndarray, of: np.ndarray) -> np.ndarray:
        """The block of each hash in its shard's filter, -1 if that is not in this group."""
        part = ((h >> np.uint64(16)) & np.uint64(_LOW)) % self.slices[of].astype(np.uint64)
        first = self.base[of, part.astype(np.int64)]
        within = ((h >> np.uint64(32)) * self.blocks[of].astype(np.uint64)) >> np.uint64(32)
        return np.where(first < 0, -1, first + within.astype(np.int64))

    def holds(self, h: np.ndarray, of: np.ndarray) -> np.ndarray:
        at = self.place(h, of)
        pattern = _PATTERNS[(h & np.uint64(_LOW)).astype(np.int64)]
        return (at >= 0) & (self.bits[np.maximum(at, 0)] & pattern == pattern)


def layout(sizes: dict[int, int], most_bytes: int) -> list[Filters]:
    """Groups of empty filters of at most ``most_bytes`` each, for so many words by shard; larger shards are sliced by hash."""
    top = max(sizes, default=0) + 1
    most = max(LEAST_BLOCKS, most_bytes // 8)
    blocks, slices = np.ones(top, np.int64), np.ones(top, np.int64)
    for s, n in sizes.items():
        need = max(LEAST_BLOCKS, -(-n * BITS // 64))
        slices[s] = -(-need // most)
        blocks[s] = -(-need // slices[s])
    groups, base, used = [], None, 0
    for s in sorted(sizes):
        for k in range(slices[s]):
            if base is None or used + blocks[s] > most:
                base, used = np.full((top, int(slices.max())), -1, np.int64), 0
                groups.append([base, 0])
            base[s, k] = used
            used += int(blocks[s])
            groups[-1][1] = used
    return [Filters(b, blocks, slices, np.zeros(n, np.uint64)) for b, n in groups]


class _Letters:
    """The code points of a batch of words, side by side: each one's word, place, and sums of the word before and after it."""

    def __init__(self, words: list[str]):
        self.length = np.array([len(w) for w in words], np.int64)
        self.code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        first = np.cumsum(self.length) - self.length
        self.word = np.repeat(np.arange(len(words)), self.length)
        self.place = np.arange(len(self.code)) - first[self.word]
        self.power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(int(self.length.max(initial=0)), _STEP, np.uint64)]))
        self.term = _code(self.code) * self.power[self.place]
        running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.term)])
        self.sum = running[first + self.length] - running[first]
        self.before = running[:-1] - running[first][self.word]
        self.again = np.zeros(len(self.code), bool)
        self.again[1:] = (self.code[1:] == self.code[:-1]) & (self.word[1:] == self.word[:-1])


def _code(points) -> np.ndarray:
    return tc.mix(np.asarray(points).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = _Letters(batch.column("word").to_pylist())
        added = [pa.array(shard(x.length).astype(np.int32)), pa.array(tc.signed(tc.mix(x.sum)))]
        yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), *added], names=["word", "n", "shard", "h"])


def _pages(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        bits = np.zeros(-(-len(f.bits) // _PAGE) * _PAGE, np.uint64)
        for batch in batches:
            h = batch.column("h").to_numpy().view(np.uint64)
            at = f.place(h, batch.column("shard").to_numpy())
            own = at >= 0
            np.bitwise_or.at(bits, at[own], _PATTERNS[(h[own] & np.uint64(_LOW)).astype(np.int64)])
        pages = bits.reshape(-1, _PAGE)
        used = np.flatnonzero(pages.any(1))
        for i in range(0, len(used), 256):
            some = used[i : i + 256]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([pages[p].tobytes() for p in some], pa.binary())], names=["page", "bits"])

    return run


def _filled(words: DataFrame, empty: Filters) -> Filters:
    """The group with its words' bits: each task sets the bits of its words, pages meet by bitwise or."""
    shared = words.sparkSession.sparkContext.broadcast(empty)
    pages = words.select("shard", "h").mapInArrow(_pages(shared), "page long, bits binary").groupBy("page").agg(F.bitmap_or_agg("bits").alias("bits"))
    bits = np.zeros(-(-len(empty.bits) // _PAGE) * _PAGE, np.uint64)
    for row in pages.toLocalIterator():
        bits[row["page"] * _PAGE : (row["page"] + 1) * _PAGE] = np.frombuffer(row["bits"], np.uint64)
    shared.unpersist()
    return Filters(empty.base, empty.blocks, empty.slices, bits)


def _found(words: list[str], x: _Letters, f: Filters, letters: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, str]]:
    """Words, places and new letters ("" for a deletion) of the edits that the filters let through."""
    for lo in range(0, len(x.code), CHUNK):
        c = slice(lo, lo + CHUNK)
        of, place, code, term, own = x.word[c], x.place[c], x.code[c], x.term[c], x.length[x.word[c]]
        total = x.sum[of]
        keep = np.flatnonzero(~x.again[c] & (own > 1))
        h = tc.mix(x.before[c][keep] + (total[keep] - x.before[c][keep] - term[keep]) * _BACK)
        hit = keep[f.holds(h, _within(shard(own[keep] - 1), f))]
        yield of[hit], place[hit], ""
        rest, power, mine = total - term, x.power[place], _within(shard(own), f)
        here = f.base[mine].max(1) >= 0
        for letter, value in zip(letters, _code(letters), strict=True):
            keep = np.flatnonzero((code < letter) & here)
            hit = keep[f.holds(tc.mix(rest[keep] + value * power[keep]), mine[keep])]
            yield of[hit], place[hit], chr(letter)


def _within(of: np.ndarray, f: Filters) -> np.ndarray:
    """Shards that no word has read as shard 0, which is never filled."""
    return np.where(of < len(f.blocks), of, 0)


def _probed(shared, letters: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 4096) for i in range(0, batch.num_rows, 4096)):
                words, n = part.column("word").to_pylist(), part.column("n").to_numpy()
                for of, place, new in _found(words, _Letters(words), shared.value, letters):
                    if len(of):
                        edit = [words[w][:i] + new + words[w][i + 1 :] for w, i in zip(of.tolist(), place.tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array([words[w] for w in of], pa.string()), pa.array(n[of]), pa.array(edit, pa.string())], names=["word", "n", "edit"])

    return run


def near_words(words: DataFrame, most_bytes: int = 32 << 20) -> DataFrame:
    """``words(word, n)``, a row per word, to ``word, n, near, near_n`` for each of two near words.

    ``most_bytes`` bounds a broadcast group of filters, whatever the size of the vocabulary; groups are probed one after another.
    A word that has no letters is near to none.  An empty table gives an empty one.
    """
    spark = words.sparkSession
    hashed = written(words.select("word", "n").where("word <> ''").mapInArrow(_hashed, "word string, n long, shard int, h long"), "hashed")
    sizes = {r["shard"]: r["count"] for r in hashed.groupBy("shard").count().collect()}  # 64 lengths and the powers of two beyond
    letters = np.array(sorted(ord(r[0]) for r in hashed.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").distinct().collect()), np.int64)
    candidates = []
    for empty in layout(sizes, most_bytes):
        own = [s for s in sizes if (empty.base[s] >= 0).any()]
        shared = spark.sparkContext.broadcast(_filled(hashed.where(F.col("shard").isin(own)), empty))
        reach = [s for s in sizes if s in own or s - 1 in own or any(o > 64 for o in own) and s > 64]
        found = hashed.where(F.col("shard").isin(reach)).select("word", "n").mapInArrow(_probed(shared, letters), "word string, n long, edit string")
        candidates.append(written(found, "candidates"))
        shared.unpersist()
    discard(hashed)
    if not candidates:
        return spark.createDataFrame([], "word string, n long, near string, near_n long")
    some = candidates[0]
    for more in candidates[1:]:
        some = some.unionByName(more)
    known = words.select(F.col("word").alias("edit"), F.col("n").alias("edit_n"))
    pairs = some.join(known, "edit")
    ends = F.array(F.struct("word", "n", F.col("edit").alias("near"), F.col("edit_n").alias("near_n")), F.struct(F.col("edit").alias("word"), F.col("edit_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    return pairs.select(F.explode(ends).alias("e")).select("e.*")


def _roots(forms: DataFrame) -> DataFrame:
    """``word, form`` to ``word, root``: paths are doubled until none grows, about log2 of log10 of the largest count times."""
    paths = written(forms.select("word", F.col("form").alias("root")), "paths")
    while True:
        on = paths.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        longer = written(paths.join(on, F.col("root") == F.col("_at"), "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("grew")), "paths")
        discard(paths)
        grew, paths = longer.where("grew").limit(1).count(), longer
        if not grew:
            return paths.select("word", "root")


def group_variants(words: DataFrame, ratio: int = 10, most_bytes: int = 32 << 20) -> DataFrame:
    """``words(word, n)``, a row per word, to ``word, form, root, n, n_near, form_n``.

    ``form`` is the near word of largest n (ties: the smallest in code-point order) if that n is at least ``ratio`` times the word's;
    ``root`` is where forms lead, the word itself if it has none.  Counts grow along forms, so they never lead back.
    Null words are left out; an empty table gives an empty one.
    """
    words = written(words.select("word", F.col("n").cast("long").alias("n")).where("word is not null"), "vocabulary")
    near = near_words(words, most_bytes)
    both = near.unionByName(words.select("word", "n", F.lit(None).cast("string").alias("near"), F.lit(None).cast("long").alias("near_n")))
    best = both.groupBy("word").agg(F.max("n").alias("n"), F.count("near").alias("n_near"), F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("less"), F.col("near")))).alias("b"))
    has = -F.col("b.less") >= ratio * F.col("n")
    formed = written(best.select("word", "n", "n_near", F.when(has, F.col("b.near")).alias("form"), F.when(has, -F.col("b.less")).alias("form_n")), "forms")
    roots = _roots(formed.where("form is not null"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def vocabulary(docs: DataFrame, least_length: int = 7, least_count: int = 2, every: int = 31, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n``: runs of letters (A-Z lowered, U+00C0 to U+00FF as they are) of at least so many code points that occur at least so often.

    Misspellings are planted by rule: with h the crc32 of ``<id>:<run>``, a run whose h is divisible by ``every`` loses its code point
    h % length.  ``every=0`` plants none.  Null texts have no words; a null id reads as empty; repeated rows count each.
    """
    upper, lower = (bytes(range(a, a + 26)).decode() for a in (65, 97))
    runs = F.regexp_extract_all(F.translate(F.col(text_col), upper, lower), F.lit(f"[a-zÀ-ÿ]{{{least_length},}}"), F.lit(0))
    word = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    if every:
        h = F.crc32(F.concat("id", F.lit(":"), "run"))
        word = word.withColumn("at", F.when(h % every == 0, (h % F.length("run")).cast("int")))
        shorter = F.concat(F.substring("run", F.lit(1), F.col("at")), F.substring("run", F.col("at") + 2, F.length("run")))
        word = word.withColumn("run", F.when(F.col("at").isNull(), F.col("run")).otherwise(shorter))
    return word.where(F.length("run") >= least_length).groupBy(F.col("run").alias("word")).agg(F.count("*").alias("n")).where(F.col("n") >= least_count)
