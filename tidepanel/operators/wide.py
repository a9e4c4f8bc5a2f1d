"""Cleaning of many features per date, without bringing a date's rows together.

What the cleaning of a date needs is a few numbers a feature: median, MAD, mean and deviation.  Medians are exact: values drawn by
chance give a bracket around each, one pass counts what lies below it and gathers what lies inside (some hundredths of the
values, equal ones as one), and a bracket that has missed its median is opened to all values.  Rows stay where they are; the numbers, four a
date and feature, are broadcast, and each row is cleaned on its own.  Features are columns, or one column ``x`` of a row's doubles as bytes, NaN for
NULL, which costs a fraction of the columns on its way to Python.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidepanel.operators.rolling import packed_bytes
from tidepanel.sources.sinks import discard, written

#: The clip is 5 robust deviations; 1.4826 makes a MAD one; the least scale and deviation.
CLIP, MAD, LEAST = 5.0, 1.4826, 1e-12
#: Values that a bracket is drawn from, per date; inner values that a task holds before it passes them on.
DRAWN, HELD = 2048, 1 << 20


@dataclass
class Statistics:
    """Arrays ``[date, feature]`` (methods take places of the rows, or the one place of all): ``median`` (NaN without values), ``mad``, and ``mean`` and ``deviation`` of the clipped values."""

    dates: dict
    median: np.ndarray
    mad: np.ndarray | None = None
    mean: np.ndarray | None = None
    deviation: np.ndarray | None = None

    def filled(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.where(np.isnan(x), np.nan_to_num(self.median[at]), x)

    def clipped(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        m, s = np.nan_to_num(self.median[at]), CLIP * MAD * self.mad[at]
        x = self.filled(x, at)
        return np.where(s <= CLIP * LEAST, x, np.clip(x, m - s, m + s))

    def scored(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        varied = ~np.isnan(self.median[at]) & (self.deviation[at] > LEAST)
        return np.where(varied, (self.clipped(x, at) - self.mean[at]) / np.where(varied, self.deviation[at], 1.0), 0.0)


def _is_packed(columns: list[str], names: list[str]) -> bool:
    return "x" in columns and names[0] not in columns


def _matrix(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    """The features as a matrix of the caller's own."""
    if _is_packed(batch.schema.names, names):
        x = batch.column("x")
        at = np.frombuffer(x.buffers()[1], np.int32, len(x) + 1, 4 * x.offset)
        return np.frombuffer(x.buffers()[2], np.float64, len(x) * len(names), int(at[0])).reshape(len(x), len(names)).copy()
    return np.stack([batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in names], 1).astype(float)


def _places(batch: pa.RecordBatch, date: str, dates: dict) -> np.ndarray:
    code = batch.column(date).dictionary_encode(null_encoding="encode")
    return np.array([dates[v] for v in code.dictionary.to_pylist()], np.int64)[code.indices.to_numpy(zero_copy_only=False)]


def _batches(batches: Iterator[pa.RecordBatch], names: list[str], date: str, dates: dict) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Each batch with its matrix, NaN for what is not finite, and the places of its dates."""
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch, names)
            x[~np.isfinite(x)] = np.nan
            yield batch, x, _places(batch, date, dates)


def _by_date(x: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The place of each date in a batch, its rows, and their values: numbers of a date then meet whole columns, and are not copied for each row."""
    order = np.argsort(at, kind="stable")
    x, at = x[order], at[order]
    bounds = [*np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])).tolist(), len(at)]
    for a, b in zip(bounds, bounds[1:]):  # noqa: B905
        yield int(at[a]), order[a:b], x[a:b]


def _brackets(shared: Broadcast, names: list[str], date: str):
    """Of drawn rows of one date the bounds, as bytes, that hold each feature's median but for 1 in a million cases; infinite for few rows."""

    def run(rows: pa.Table) -> pa.Table:
        told: Statistics = shared.value
        out = []
        for batch, x, at in _batches(rows.combine_chunks().to_batches(max_chunksize=None), names, date, told.dates):
            if told.median is not None:
                x = np.abs(told.filled(x, at) - np.nan_to_num(told.median[at]))
            x, n = np.sort(x, 0), (~np.isnan(x)).sum(0)
            low, high = np.floor(n / 2 - 2.5 * np.sqrt(n)).astype(int) - 1, np.ceil(n / 2 + 2.5 * np.sqrt(n)).astype(int) + 1
            column = np.arange(len(names))
            a = np.where(low < 0, -np.inf, x[np.maximum(low, 0), column])
            b = np.where(high >= n, np.inf, x[np.minimum(high, len(x) - 1), column])
            out.append((int(at[0]), a.tobytes(), b.tobytes()))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["at", "low", "high"])

    return run


def _within(shared: Broadcast, names: list[str], date: str):
    """Per (date, feature) the values inside its bracket with their numbers, and how many are below it and known at all."""
    k = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told, low, high, asked = shared.value
        below, known, codes, values, held = np.zeros(low.size, np.int64), np.zeros(low.size, np.int64), [], [], 0

        def passed_on() -> pa.RecordBatch:
            code, value = (np.concatenate(p) if p else np.zeros(0, t) for p, t in ((codes, np.int64), (values, np.float64)))
            order = np.argsort(value)
            for low_bits in (code & 0xFFFF, code >> 16)[: 1 + (low.size > 1 << 16)]:  # codes of 16 bits are sorted by their digits
                order = order[np.argsort(low_bits[order].astype(np.uint16), kind="stable")]
            code, value = code[order], value[order]
            first = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (value[1:] != value[:-1])])) if len(code) else np.zeros(0, np.int64)
            many = np.diff(np.concatenate([first, [len(code)]])).astype(np.int64)
            code, value = code[first], value[first]
            own = np.flatnonzero(known)
            a, b = np.searchsorted(code, own, "left"), np.searchsorted(code, own, "right")
            single = many.max(initial=1) == 1  # then the numbers go without saying
            parts = [[b"" if single and v is many else v[i:j].tobytes() for i, j in zip(a, b, strict=True)] for v in (value, many)]
            return pa.RecordBatch.from_arrays([pa.array(own), pa.array(below[own]), pa.array(known[own]), *(pa.array(p, pa.binary()) for p in parts)], names=["code", "below", "known", "values", "many"])

        for _, x, at in _batches(batches, names, date, told.dates):
            for p, _, own in _by_date(x, at):
                if told.median is not None:
                    own = np.abs(told.filled(own, p) - np.nan_to_num(told.median[p]))
                here = slice(p * k, p * k + k)
                use = ~np.isnan(own) & asked[here]
                under = (own < low[here]) & use
                inner = (own <= high[here]) & use & ~under
                known[here] += use.sum(0)
                below[here] += under.sum(0)
                codes.append(p * k + np.nonzero(inner)[1])
                values.append(own[inner])
                held += len(values[-1])
            if held > HELD:
                yield passed_on()
                below[:], known[:], held = 0, 0, 0
                codes.clear()
                values.clear()
        if known.any():
            yield passed_on()

    return run


def _medians(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The median of each code from all its parts; ``found`` is false where the bracket has missed it."""
    parts: dict[int, list] = {}
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("code", "below", "known", "values", "many")), strict=True):
            parts.setdefault(row[0], []).append(row[1:])
    out = []
    for code, own in parts.items():
        below, known = sum(p[0] for p in own), sum(p[1] for p in own)
        value, many = np.concatenate([np.frombuffer(p[2]) for p in own]), np.concatenate([np.frombuffer(p[3], np.int64) if p[3] else np.ones(len(p[2]) // 8, np.int64) for p in own])
        order = np.argsort(value, kind="stable")
        upto = below + np.cumsum(many[order])
        ranks = np.array([(known - 1) // 2, known // 2])  # from 0
        found = below <= ranks[0] and len(upto) > 0 and ranks[1] < upto[-1]
        middle = value[order[np.searchsorted(upto, ranks, "right")]].mean() if found else 0.0
        out.append((code, bool(found), float(middle)))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.bool_(), pa.float64()), strict=True)], names=["code", "found", "median"])


def _median(rows: DataFrame, drawn: DataFrame, names: list[str], date: str, told: Statistics, size: int) -> np.ndarray:
    """Exact medians ``[date, feature]`` of the features, or of their distances from ``told.median``; NaN without values."""
    spark = rows.sparkSession
    shape = (len(told.dates), len(names))
    low, high, out = np.full(shape, -np.inf), np.full(shape, np.inf), np.full(shape, np.nan)
    shared = spark.sparkContext.broadcast(told)
    for r in drawn.groupBy(date).applyInArrow(_brackets(shared, names, date), "at long, low binary, high binary").collect():  # a row per date
        low[r["at"]], high[r["at"]] = np.frombuffer(r["low"]), np.frombuffer(r["high"])
    shared.unpersist()
    asked = np.ones(shape, bool)
    # about 64 MB of gathered values a task
    tasks = max(spark.sparkContext.defaultParallelism, int(size * len(names) * 0.1 * 16 / 2**26))
    while asked.any():
        shared = spark.sparkContext.broadcast((told, low.reshape(-1), high.reshape(-1), asked.reshape(-1)))
        inner = rows.mapInArrow(_within(shared, names, date), "code long, below long, known long, values binary, many binary")
        found = inner.repartition(tasks, "code").mapInArrow(_medians, "code long, found boolean, median double").collect()  # a row per date and feature
        shared.unpersist()
        asked = np.zeros(shape, bool)
        for r in found:
            if r["found"]:
                out.flat[r["code"]] = r["median"]
            else:
                asked.flat[r["code"]], low.flat[r["code"]], high.flat[r["code"]] = True, -np.inf, np.inf
    return out


def _summed(shared: Broadcast, names: list[str], date: str, terms: Callable[[Statistics, np.ndarray, np.ndarray, int], list[np.ndarray]]):
    """Sums of ``terms(statistics, raw, cleaned of what is not finite, place of the date)`` over a task's rows, per date, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: Statistics = shared.value
        total: dict[int, np.ndarray] = {}
        for batch, x, at in _batches(batches, names, date, told.dates):
            raw = _matrix(batch, names) if terms is _checks else x
            for p, rows, own in _by_date(x, at):
                s = np.stack([t.sum(0, float) for t in terms(told, raw[rows] if raw is not x else own, own, p)])
                total[p] = total[p] + s if p in total else s
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([s.tobytes() for s in total.values()], pa.binary())], names=["at", "sums"])

    return run


def _per_date(rows: DataFrame, shared: Broadcast, names: list[str], date: str, terms) -> DataFrame:
    """``at, parts``: the sums of each task, a row per date."""
    parts = rows.mapInArrow(_summed(shared, names, date, terms), "at long, sums binary")
    return parts.groupBy("at").agg(F.sort_array(F.collect_list("sums")).alias("parts"))  # a row a task and date; sorted, so that sums do not depend on their order


def _moments(told: Statistics, raw: np.ndarray, x: np.ndarray, at: int) -> list[np.ndarray]:
    away = told.clipped(x, at) - np.nan_to_num(told.median[at])
    return [np.ones(x.shape), away, away * away]


def statistics(rows: DataFrame, names: list[str], date: str) -> Statistics:
    """Four passes over ``rows``, which should be stored if they are costly: draws, medians, MADs, moments."""
    spark = rows.sparkSession
    sizes = rows.groupBy(date).agg(F.count(F.lit(1)).alias("_n"))
    counts = sizes.collect()  # a row per date
    told = Statistics({r[date]: k for k, r in enumerate(sorted(counts, key=lambda r: (r[date] is not None, r[date])))}, None)
    if not counts:
        return Statistics({}, *(np.zeros((0, len(names))) for _ in range(4)))
    size = sum(r["_n"] for r in counts)
    drawn = written(rows.join(F.broadcast(spark.createDataFrame(counts, sizes.schema)), date).where(F.rand(7) * F.col("_n") < DRAWN).select(date, *(["x"] if _is_packed(rows.columns, names) else names)), "drawn")
    told.median = _median(rows, drawn, names, date, told, size)
    told.mad = np.nan_to_num(_median(rows, drawn, names, date, told, size))
    discard(drawn)
    told.mean, told.deviation = np.zeros(told.mad.shape), np.zeros(told.mad.shape)
    shared = spark.sparkContext.broadcast(told)
    for r in _per_date(rows, shared, names, date, _moments).collect():
        n, s, q = sum(np.frombuffer(p).reshape(3, -1) for p in r["parts"])
        told.mean[r["at"]] = np.nan_to_num(told.median[r["at"]]) + s / n
        told.deviation[r["at"]] = np.sqrt(np.maximum(q / n - (s / n) ** 2, 0.0))
    shared.unpersist()
    return told


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(np.ascontiguousarray(x).reshape(-1)))


def _standardised(shared: Broadcast, names: list[str], date: str, then: Callable[[np.ndarray], np.ndarray] | None, listed: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x, at in _batches(batches, names, date, shared.value.dates):
            z = np.empty(x.shape)
            for p, rows, own in _by_date(x, at):
                z[rows] = shared.value.scored(own, p)
            if _is_packed(batch.schema.names, names):
                made = {"x": (_lists if listed else packed_bytes)(then(z) if then else z)}
            else:
                made = {n: pa.array(z[:, k]) for k, n in enumerate(names)}
            yield pa.RecordBatch.from_arrays([made.get(c, batch.column(c)) for c in batch.schema.names], names=batch.schema.names)

    return run


def preprocess(rows: DataFrame, names: list[str], date: str, then: Callable[[np.ndarray], np.ndarray] | None = None, listed: bool = False) -> DataFrame:
    """Median fill, clip and z-score of each feature (doubles) per date.

    Of packed rows ``x`` is what ``then`` makes of the z-scores of rows, as bytes, or as an array of doubles if ``listed``.
    """
    shared = rows.sparkSession.sparkContext.broadcast(statistics(rows, names, date))
    schema = ", ".join(f"`{c}` {'array<double>' if listed and c == 'x' else t}" for c, t in rows.dtypes)
    return rows.mapInArrow(_standardised(shared, names, date, then, listed), schema)


def _checks(told: Statistics, raw: np.ndarray, x: np.ndarray, at: int) -> list[np.ndarray]:
    scale, m = MAD * told.mad[at], told.median[at]
    filled, z = told.filled(x, at), told.scored(x, at)
    beyond = (scale > LEAST) & ((filled < m - CLIP * scale) | (filled > m + CLIP * scale))
    return [beyond, np.ones(x.shape), ~np.isnan(x), np.isinf(raw), np.where(np.isfinite(z), z, 0.0), np.where(np.isfinite(z), z * z, 0.0), np.isfinite(z)]


QUALITY = "feature string, clipped_count long, n_rows long, finite_before long, infinite_before long, median double, mad double, zero_variance boolean, post_mean double, post_std double, finite_after long"


def quality(rows: DataFrame, names: list[str], date: str) -> DataFrame:
    """Per (date, feature) what the cleaning met and left: a fifth pass, with all numbers at hand."""
    shared = rows.sparkSession.sparkContext.broadcast(statistics(rows, names, date))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: Statistics = shared.value
        dates = {k: d for d, k in told.dates.items()}
        for batch in batches:
            for at, parts in zip(batch.column("at").to_pylist(), batch.column("parts").to_pylist(), strict=True):
                clipped, n, finite, infinite, z, zz, after = sum(np.frombuffer(p).reshape(7, -1) for p in parts)
                none = np.isnan(told.median[at])
                columns = [
                    pa.array([dates[at]] * len(names), batch_type), pa.array(names), *(pa.array(c.astype(np.int64)) for c in (clipped, n, finite, infinite)),
                    pa.array(told.median[at], from_pandas=True), pa.array(np.where(none, np.nan, told.mad[at]), from_pandas=True), pa.array(none | (told.deviation[at] <= LEAST)),
                    pa.array(z / after), pa.array(np.sqrt(np.maximum(zz / after - (z / after) ** 2, 0.0))), pa.array(after.astype(np.int64)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[date, *(f.split()[0] for f in QUALITY.split(", "))])

    batch_type = to_arrow_type(rows.schema[date].dataType)
    return _per_date(rows, shared, names, date, _checks).mapInArrow(run, f"`{date}` {dict(rows.dtypes)[date]}, {QUALITY}")
