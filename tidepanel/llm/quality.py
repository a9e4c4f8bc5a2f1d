"""Operator 12: a quality classifier from positive and unlabelled texts.

Trusted positives are texts labelled good; every text is unlabelled web text.  With a class prior p, the logistic loss
and a linear score z, the non-negative unbiased risk is

    p * mean_pos(log(1 + exp(-z))) + max(0, mean_all(log(1 + exp(z))) - p * mean_pos(log(1 + exp(z))))

and z at its least is the log odds of a good text.  Texts become short vectors of shape and repetition; risk, gradient
and curvature are sums over all of them, made in Arrow batches and added by Spark.  Nothing is sampled.  What reaches the driver
is a few thousand numbers a step, whatever the number of texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm import textcodes as tc
from tidepanel.llm.store import discard, small_batches, written

#: Byte classes: other, space, line end, lower, upper, digit, stop, mark, beyond ASCII.
_CLASSES = 9
_CLASS = np.zeros(256, np.int64)
_CLASS[33:127] = 7
_CLASS[[9, 11, 12, 13, 32]], _CLASS[10], _CLASS[128:] = 1, 2, 8
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 3, 4, 5
_CLASS[[ord(c) for c in ".,;:?!'\"()-"]] = 6
_OWN = 8
#: Length of a text's vector, without the constant.
WIDTH = _CLASSES * _CLASSES + _OWN
#: Standardised values beyond this are moved to it.
CLIP = 5.0
BINS = 1000


@dataclass(frozen=True)
class Model:
    """Means and scales of the vectors, weights (the last is the constant), and the estimated share of good texts."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    prior: float

    def standard(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -CLIP, CLIP)
        return np.concatenate([z, np.ones((len(z), 1))], 1)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from; a null id is none of them."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _pieces(data: np.ndarray, size: int = tc.CHUNK) -> Iterator[tuple[int, int]]:
    """Bounds of pieces of about ``size`` bytes that end behind a space; a longer word makes a longer piece."""
    at = 0
    while at < len(data):
        stop = at + size
        while stop < len(data) and not tc.SPACES[data[stop - 1]]:
            found = np.flatnonzero(tc.SPACES[data[stop : stop + size]])
            stop += int(found[0]) + 1 if len(found) else size
        stop = min(stop, len(data))
        yield at, stop
        at = stop


def _distinct(h: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each text, and the count of its most frequent one."""
    values, index, count = np.unique(tc.mix(h ^ (of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))), return_index=True, return_counts=True)
    top = np.zeros(n)
    np.maximum.at(top, of[index], count)
    return np.bincount(of[index], minlength=n), top


def vectors(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of ``WIDTH`` numbers for each text of a chunk; an empty text has zeros.

    Square roots of the shares of byte-class pairs, then: log bytes, log words, log bytes a word, shares of words like the one before, of distinct
    words, pairs of words and lines, and of the most frequent word.
    """
    n, size = len(offsets) - 1, np.diff(offsets)
    pairs = np.zeros((n, _CLASSES * _CLASSES))
    hashes, owners, lines, line_owners = [], [], [], []
    for lo, hi in _pieces(data) if n == 1 else [(0, len(data))]:
        own = np.clip(offsets, lo, hi) - lo
        part = data[lo:hi]
        text = np.repeat(np.arange(n), np.diff(own))
        kind = _CLASS[part]
        same = text[1:] == text[:-1]
        pairs += np.bincount((text[1:] * _CLASSES * _CLASSES + kind[:-1] * _CLASSES + kind[1:])[same], minlength=n * _CLASSES * _CLASSES).reshape(n, -1)
        words = tc.Words(part, own, tc.SPACES)
        hashes.append(words.hashes())
        owners.append(words.texts())
        rows = tc.Words(part, own, _LINE_ENDS)
        lines.append(rows.hashes())
        line_owners.append(rows.texts())
    h, of, line, line_of = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (hashes, owners, lines, line_owners))
    of, line_of = of.astype(np.int64), line_of.astype(np.int64)
    many = np.bincount(of, minlength=n)
    some = np.maximum(many, 1)
    follows = of[1:] == of[:-1] if len(of) else np.zeros(0, bool)
    again = np.bincount(of[1:][follows & (h[1:] == h[:-1])], minlength=n)
    kinds, top = _distinct(h, of, n)
    two, _ = _distinct(tc.joined(h[:-1], h[1:])[follows], of[1:][follows], n)
    line_kinds, _ = _distinct(line, line_of, n)
    own = [np.log1p(size), np.log1p(many), np.log1p(size / some), again / some, kinds / some, two / some, line_kinds / np.maximum(np.bincount(line_of, minlength=n), 1), top / some]
    return np.concatenate([np.sqrt(pairs / np.maximum(size[:, None], 1)), np.stack(own, 1)], 1)


_LINE_ENDS = np.zeros(256, bool)
_LINE_ENDS[10] = True


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in tc.slices(batches):
        data, offsets = tc.buffers(batch.column("text"))
        x = np.zeros((batch.num_rows, WIDTH), np.float32)
        for i, j, part, own in tc.chunked(data, offsets):
            x[i:j] = vectors(part, own)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _lists(x)], names=["doc_id", "x"])


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.reshape(-1)))


def _read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH).astype(np.float64)
    return x, batch.column("trusted").to_numpy(zero_copy_only=False).astype(bool)


def _summed(table: DataFrame, of) -> np.ndarray:
    """``of(x, trusted)``, a vector for each batch of rows, added up over the whole table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for batch in batches:
            if batch.num_rows:
                total = total + of(*_read(batch))
        if np.ndim(total):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["at", "v"])

    rows = table.select("x", "trusted").mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(max((r["at"] for r in rows), default=-1) + 1)
    for r in rows:
        out[r["at"]] = r["v"]
    return out


def _soft(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def _moments(x: np.ndarray, trusted: np.ndarray) -> np.ndarray:
    return np.concatenate([[len(x), trusted.sum()], x.sum(0), (x * x).sum(0)])


def _step_sums(model: Model, weight: np.ndarray):
    """Sums that risk, gradient and curvature are made of, with scores by ``weight``: of all texts, then of trusted ones."""

    def of(x: np.ndarray, trusted: np.ndarray) -> np.ndarray:
        x = model.standard(x)
        z = x @ weight
        s = 1 / (1 + np.exp(-z))
        p, zp, sp = x[trusted], z[trusted], s[trusted]
        curve, curve_p = (x * (s * (1 - s))[:, None]).T @ x, (p * (sp * (1 - sp))[:, None]).T @ p
        return np.concatenate([[_soft(z).sum(), _soft(zp).sum(), _soft(-zp).sum()], s @ x, sp @ p, p.sum(0), curve.reshape(-1), curve_p.reshape(-1)])

    return of


def _histogram(model: Model, weight: np.ndarray):
    def of(x: np.ndarray, trusted: np.ndarray) -> np.ndarray:
        at = np.minimum((BINS / (1 + np.exp(-(model.standard(x) @ weight)))).astype(np.int64), BINS - 1)
        return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at[trusted], minlength=BINS)]).astype(np.float64)

    return of


def prior_of(everything: np.ndarray, trusted: np.ndarray) -> float:
    """Share of good texts, from score histograms: at every threshold it is at most share of all above / share of trusted above.

    The threshold with the least upper confidence bound of that ratio is taken; without texts of either kind, 0.5.
    """
    n, m = everything.sum(), trusted.sum()
    if not n or not m:
        return 0.5
    above, good = np.cumsum(everything[::-1]) / n, np.cumsum(trusted[::-1]) / m
    slack = 0.5 * (np.sqrt(np.log(40) / (2 * n)) + np.sqrt(np.log(40) / (2 * m)))
    usable = good > 0
    ratio = above[usable] / good[usable]
    return float(np.clip(ratio[np.argmin(ratio + slack / good[usable])], 0.01, 0.99))


def fit(table: DataFrame, steps: int = 10) -> Model:
    """Fit on ``(x, trusted)``, all rows: a separator of trusted and all texts on one half, from its scores of the other half the prior, then the risk at that prior.

    Newton steps, halved while the risk grows; where the part of the negatives falls below 0, a step raises it again.
    Without rows or trusted rows the model scores 0.5.
    """
    moments = _summed(table, _moments)
    n, m = (moments[0], moments[1]) if len(moments) else (0.0, 0.0)
    empty = Model(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH + 1), 0.5)
    if not n or not m:
        return empty
    mean, square = moments[2 : 2 + WIDTH] / n, moments[2 + WIDTH :] / n
    deviation = np.sqrt(np.maximum(square - mean * mean, 0))
    model = Model(mean, np.where(deviation > 1e-6, deviation, 1.0), empty.weight, 0.5)
    k, ridge = WIDTH + 1, np.append(np.full(WIDTH, max(1e-4, 2 / m)), 1e-9)

    def sums(weight, rows, n, m):
        v = _summed(rows, _step_sums(model, weight))
        cut = np.split(v, np.cumsum([3, k, k, k, k * k]))
        return cut[0], cut[1] / n, cut[2] / m, cut[3] / m, cut[4].reshape(k, k) / n, cut[5].reshape(k, k) / m

    first = F.pmod(F.xxhash64("x"), F.lit(2)) == 0  # equal texts fall into one half
    half, rest = table.where(first), table.where(~first)
    size = _summed(half, lambda x, trusted: np.array([len(x), trusted.sum()], np.float64))
    counts = np.zeros(2 * BINS)
    if len(size) and size.min():
        weight = np.zeros(k)
        for _ in range(4):  # trusted (half) against all (half)
            _, all_g, good_g, good_x, all_h, good_h = sums(weight, half, *size)
            weight = weight - np.linalg.solve(0.5 * (all_h + good_h) + np.diag(ridge), 0.5 * (all_g + good_g - good_x) + ridge * weight)
        counts = np.append(_summed(rest, _histogram(model, weight)), np.zeros(2 * BINS))[: 2 * BINS]
    prior = prior_of(counts[:BINS], counts[BINS:])
    weight, best, least, step = np.append(np.zeros(WIDTH), np.log(prior / (1 - prior))), None, np.inf, None
    for _ in range(steps):
        loss, all_g, good_g, good_x, all_h, _ = sums(weight, table, n, m)
        negative = loss[0] / n - prior * loss[1] / m
        risk = prior * loss[2] / m + max(0.0, negative) + 0.5 * (ridge * weight * weight).sum()
        if risk < least - 1e-7 or best is None:
            best, least = weight, risk
            if negative >= 0:
                slope = all_g - prior * good_x + ridge * weight
            else:
                slope = -(all_g - prior * good_g)
            step = np.linalg.solve(all_h + np.diag(ridge), slope)
        elif risk < least + 1e-7:
            break
        else:
            step = step / 2
        weight = best - step
    return Model(model.mean, model.scale, np.round(best, 6), prior)


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            z = model.standard(batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH).astype(np.float64)) @ model.weight
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-z)))], names=["doc_id", "score"])

    return run


def score(table: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` for each row of ``table(doc_id, x)``."""
    shared = table.sparkSession.sparkContext.broadcast(model)
    return table.select("doc_id", "x").mapInArrow(_scored(shared), f"doc_id {dict(table.dtypes)['doc_id']}, score double")


def describe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, x``: the vector of each whole text; a null text reads as empty."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_described, f"doc_id {dict(rows.dtypes)['doc_id']}, x array<float>")


def trusted_ids(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """Ids that are labelled good and never otherwise, held-out ones left out; null ids and labels are ignored."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("y")).where("doc_id is not null and y is not null")
    return known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("y").alias("least"), F.max("y").alias("most")).where("least = 1 and most = 1").select("doc_id")


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Model]:
    """``doc_id, score`` (0 to 1) for each row of ``docs``, and the model.

    Labels say which texts are trusted, and nothing else: a label 0 is not used.  Null and empty texts have the vector of zeros and a score
    like any other; repeated rows count and are scored each; null ids are unlabelled; other columns are ignored; an empty table gives an empty one.
    """
    plain = written(describe(docs, id_col, text_col), "vectors")
    good = trusted_ids(labels).withColumn("trusted", F.lit(True))
    table = written(plain.join(good, "doc_id", "left").withColumn("trusted", F.coalesce("trusted", F.lit(False))), "flagged")
    discard(plain)
    model = fit(table)
    return score(table, model), model
