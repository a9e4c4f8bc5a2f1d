"""Operator 5: language identification by multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased; every run of characters that are not letters reads as one kind of
gap.  Runs of 1 to ``ORDERS`` characters are hashed into ``BUCKETS`` counters each.  The
log-probability matrix (languages x orders x buckets) is broadcast; its size is bounded by
``max_languages``.  Batches are scored sparsely: one gather and one segmented sum per
language and order.
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

ORDERS, BUCKETS, PIECE = 3, 1 << 15, 1 << 19


@dataclass(frozen=True)
class Model:
    """``log_p[language, order * BUCKETS + bucket]`` and log priors."""

    languages: tuple[str, ...]
    log_p: np.ndarray
    prior: np.ndarray


def _pieces(texts: list[str | None]) -> Iterator[tuple[list[int], list[np.ndarray], list[int]]]:
    """Groups of about ``PIECE`` characters: text numbers, code arrays, n-gram starts in each.

    A long text is cut with an overlap of ORDERS - 1 characters, so no n-gram is lost or counted twice.
    """
    owner, codes, starts, total = [], [], [], 0
    for k, text in enumerate(texts):
        text = (text or "").lower()
        for s in range(0, len(text), PIECE):
            part = text[s : s + PIECE + ORDERS - 1]
            owner.append(k)
            codes.append(np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32))
            starts.append(min(PIECE, len(text) - s))
            total += len(part)
            if total >= PIECE:
                yield owner, codes, starts
                owner, codes, starts, total = [], [], [], 0
    if owner:
        yield owner, codes, starts


def _grams(codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Start and length of each piece in the joined codes, and bucket numbers per order."""
    length = np.array([len(c) for c in codes])
    x = np.concatenate([*codes, np.zeros(ORDERS, np.uint32)])
    letter = ((x >= 97) & (x <= 122)) | (x >= 0xC0)
    x = np.where(letter, x, np.uint32(32))
    out, h = [], x * np.uint32(0x9E3779B1)
    for n in range(ORDERS):
        if n:
            h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + x[n:] * np.uint32(0x9E3779B1)
        out.append(((h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35) >> np.uint32(17)).astype(np.int32))
    return np.cumsum(length) - length, length, out


def _bounds(at: np.ndarray, length: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    many = np.clip(np.minimum(starts, length - n), 0, None)
    return at, at + many


def scores(model: Model, texts: list[str | None]) -> np.ndarray:
    """Joint log scores, a row per text."""
    out = np.tile(model.prior, (len(texts), 1))
    for owner, codes, starts in _pieces(texts):
        at, length, grams = _grams(codes)
        for n, g in enumerate(grams):
            lo, hi = _bounds(at, length, np.array(starts), n)
            cuts = np.stack([lo, hi], 1).reshape(-1)
            full = hi > lo
            for k in range(len(model.languages)):
                values = model.log_p[k, n * BUCKETS : (n + 1) * BUCKETS][g]
                sums = np.add.reduceat(np.append(values, np.float32(0)), cuts, dtype=np.float64)[::2]
                np.add.at(out[:, k], np.array(owner)[full], sums[full])
    return out


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in batches:
        for lang, own in f.groupby("lang"):
            total = np.zeros(ORDERS * BUCKETS, np.int64)
            for _, codes, starts in _pieces(own["text"].tolist()):
                at, length, grams = _grams(codes)
                for n, g in enumerate(grams):
                    lo, hi = _bounds(at, length, np.array(starts), n)
                    inside = np.zeros(len(g) + 1, np.int64)
                    np.add.at(inside, lo, 1)
                    np.add.at(inside, hi, -1)
                    total[n * BUCKETS : (n + 1) * BUCKETS] += np.bincount(g[np.cumsum(inside)[:-1] > 0], minlength=BUCKETS)
            bucket = np.flatnonzero(total)
            yield pd.DataFrame({"lang": lang, "bucket": bucket.astype(np.int32), "n": total[bucket], "docs": 0})
            yield pd.DataFrame({"lang": [lang], "bucket": np.array([-1], np.int32), "n": [len(own)], "docs": [len(own)]})


def fit(labelled: DataFrame, per_language: int = 3000, max_languages: int = 256, alpha: float = 0.5) -> Model:
    """Fit on ``(doc_id, text, lang)``: about ``per_language`` texts of each language, whole, chosen by hash.

    Only the ``max_languages`` most frequent languages are learned.  Null texts and langs are ignored.
    """
    rows = labelled.where("lang is not null and text is not null")
    many = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages)
    share = {r["lang"]: min(1.0, per_language / r["n"]) for r in many.collect()}
    if not share:
        return Model((), np.zeros((0, ORDERS * BUCKETS), np.float32), np.zeros(0))
    pick = F.create_map(*[F.lit(x) for pair in share.items() for x in pair])
    draw = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) / 1_000_000
    sample = rows.where(draw < F.coalesce(pick[F.col("lang")], F.lit(0.0))).select("lang", "text")
    found = sample.mapInPandas(_counts, "lang string, bucket int, n long, docs long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = tuple(sorted(set(found["lang"])))
    counts = np.zeros((len(languages), ORDERS * BUCKETS))
    docs = np.zeros(len(languages))
    row = found["lang"].map({x: k for k, x in enumerate(languages)}).to_numpy(np.int64)
    bucket, n = found["bucket"].to_numpy(np.int64), found["n"].to_numpy(np.float64)
    own = bucket >= 0
    counts[row[own], bucket[own]] = n[own]
    docs[row[~own]] = n[~own]
    log_p = np.zeros_like(counts, dtype=np.float32)
    for k in range(ORDERS):
        part = counts[:, k * BUCKETS : (k + 1) * BUCKETS] + alpha
        log_p[:, k * BUCKETS : (k + 1) * BUCKETS] = np.log(part / part.sum(1, keepdims=True))
    return Model(languages, log_p, np.log((docs + 1) / (docs + 1).sum()))


def _predicted(parts, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*parts.value)
        for batch in tc.slices(batches):
            lang, score = [], []
            texts = batch.column(text_col).to_pylist()
            for i in range(0, len(texts), 512):
                part = texts[i : i + 512]
                joint = scores(model, part)
                for text, row in zip(part, joint, strict=True):
                    if not text or not len(row) or not any(map(str.isalpha, text)):
                        lang.append("und")
                        score.append(0.0)
                    else:
                        best = int(np.argmax(row))
                        lang.append(model.languages[best])
                        score.append(float(1 / np.exp(row - row[best]).sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return run


def predict(rows: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``rows`` with ``lang_pred`` and ``score`` (posterior probability).

    ``und`` with score 0 for null texts and texts without letters, and for all if nothing
    was learned.  Columns named ``lang_pred`` or ``score`` are replaced.  Ties go to the
    smaller language code.  Whole texts are scored, cut into pieces only for memory.
    """
    rows = rows.drop("lang_pred", "score")
    parts = rows.sparkSession.sparkContext.broadcast((model.languages, model.log_p, model.prior))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "lang_pred string", "score double"])
    return rows.mapInArrow(_predicted(parts, text_col), schema)


def held_out(doc_id):
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))
