"""Rolling features per security: 13 ratios of one row, and 29 families over five windows.

All columns share one partitioning and order, so the whole set costs one shuffle and one sort; frames are evaluated in Arrow batches.
Partial frames give values; a NULL result stands for every non-finite one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.functions.core import EPS, clean, sdiv, series

#: Window lengths, and the least sample deviation for which a fit is meaningful.
WINDOWS = (5, 10, 20, 30, 60)
LEAST_STD = 2e-5


def candles() -> dict[str, Column]:
    o, h, l, c = (F.col(f"adjusted_{x}") for x in ("open", "high", "low", "close"))
    body, span = c - o, h - l + EPS
    up, down, shift = h - F.greatest(o, c), F.least(o, c) - l, 2 * c - h - l
    return {
        "kmid": sdiv(body, o), "klen": sdiv(h - l, o), "kmid2": sdiv(body, span), "kup": sdiv(up, o), "kup2": sdiv(up, span),
        "klow": sdiv(down, o), "klow2": sdiv(down, span), "ksft": sdiv(shift, o), "ksft2": sdiv(shift, span),
        "open0": sdiv(o, c), "high0": sdiv(h, c), "low0": sdiv(l, c), "vwap0": sdiv(F.col("vwap"), c),
    }


def prepared(panel: DataFrame, *carry: str) -> DataFrame:
    """Base fields with what several families need of the row before; ``carry`` names columns to keep."""
    s = series()
    c, v = F.col("adjusted_close"), F.col("volume").cast("double")
    rows = panel.withColumns({"__c": F.lag("adjusted_close").over(s), "__v": F.lag("volume").over(s).cast("double"), "__rn": F.row_number().over(s).cast("double")})
    before, v_before = F.col("__c"), F.col("__v")
    return rows.select(
        "trade_date", "security_id", *carry, *(clean(F.col(f"adjusted_{x}").cast("double")).alias(x) for x in ("open", "high", "low", "close")), clean(v).alias("v"),
        F.col("__rn").alias("rn"),
        F.ln(v + 1).alias("lv"), sdiv(c, before).alias("cr"), F.ln(sdiv(v, v_before) + 1).alias("vr"),
        (c - before).alias("dc"), (v - v_before).alias("dv"), (F.abs(sdiv(c, before) - 1) * v).alias("wv"),
        F.coalesce((c > before).cast("double"), F.lit(0.0)).alias("up"), F.coalesce((c < before).cast("double"), F.lit(0.0)).alias("down"),
    )


class Sums:
    """Sums over the last d rows of each row's series, for rows side by side in order of (series, date).

    ``values`` have ``reach`` rows more than ``place``, before them; ``known`` tells which are not NULL.  A frame's values meet lag after lag,
    so that one walk over the lags serves all windows.  They are taken as differences from the latest known value, which
    is one of the frame's own: a constant frame has a deviation of exactly 0, and means far from 0 cost no digits.
    """

    def __init__(self, values: dict[str, np.ndarray], known: dict[str, np.ndarray], place: np.ndarray, windows: tuple[int, ...], reach: int) -> None:
        self.values, self.known, self.place, self.windows, self.reach = values, known, place, windows, reach
        self.made: dict[tuple, dict[int, np.ndarray]] = {}

    def at(self, x: np.ndarray, lag: int) -> np.ndarray:
        return x[self.reach - lag : self.reach - lag + len(self.place)]

    def own(self, name: str) -> np.ndarray:
        return np.where(self.at(self.known[name], 0), self.at(self.values[name], 0), np.nan)

    def before(self, name: str, d: int) -> np.ndarray:
        """The value d rows before."""
        return np.where(self.at(self.known[name], d) & (self.place > d), self.at(self.values[name], d), np.nan)

    def latest(self, name: str, known: np.ndarray) -> np.ndarray:
        """The last known value up to each row; of no account where the frame has none."""
        last = np.maximum.accumulate(np.where(known, np.arange(len(known)), 0))
        return self.at(self.values[name][last], 0)

    def walk(self, key: tuple, start: float, step: Callable[[np.ndarray, int], np.ndarray]) -> dict[int, np.ndarray]:
        """``step(total, lag)`` from lag 0 on; the totals of each window."""
        if key not in self.made:
            total, out = np.full(len(self.place), start), {}
            for lag in range(max(self.windows)):
                total = step(total, lag)
                if lag + 1 in self.windows:
                    out[lag + 1] = total
            self.made[key] = out
        return self.made[key]

    def total(self, name: str, d: int, what: str = "") -> np.ndarray:
        """Sum of the known values, of their rises, falls or amounts; NaN without any."""
        part = {"": lambda x: x, "rise": lambda x: np.maximum(x, 0.0), "fall": lambda x: np.maximum(-x, 0.0), "amount": np.abs}[what]
        x, k = part(self.values[name]), self.known[name]
        found = self.walk((name, what), 0.0, lambda t, lag: t + np.where(self.at(k, lag) & (self.place > lag), self.at(x, lag), 0.0))
        return np.where(self.moments(name, d)["n"] > 0, found[d], np.nan)

    def extreme(self, name: str, d: int, top: bool) -> np.ndarray:
        pick, none = (np.maximum, -np.inf) if top else (np.minimum, np.inf)
        x, k = self.values[name], self.known[name]
        found = self.walk((name, top), none, lambda t, lag: pick(t, np.where(self.at(k, lag) & (self.place > lag), self.at(x, lag), none)))
        return found[d]

    def moments(self, a: str, d: int, b: str | None = None) -> dict[str, np.ndarray]:
        """Rows ``n`` where all is known, means ``ma, mb``, sums of squared deviations ``aa, bb`` and of products ``ab``; without ``b``, that is the row's position."""
        if (a, b) not in self.made:
            known = self.known[a] if b is None else self.known[a] & self.known[b]
            x, x0 = self.values[a], self.latest(a, known)
            y, y0 = (None, None) if b is None else (self.values[b], self.latest(b, known))
            sums, out = [np.zeros(len(self.place)) for _ in range(6)], {}
            for lag in range(max(self.windows)):
                inside = self.at(known, lag) & (self.place > lag)
                p = np.where(inside, self.at(x, lag) - x0, 0.0)
                q = np.where(inside, -float(lag) if b is None else self.at(y, lag) - y0, 0.0)
                for total, part in zip(sums, (inside, p, q, p * p, q * q, p * q), strict=True):
                    total += part
                if lag + 1 in self.windows:
                    n, sp, sq, pp, qq, pq = (total.copy() for total in sums)
                    out[lag + 1] = {"n": n, "ma": x0 + sp / n, "mb": sq / n, "shift": sp / n, "aa": np.maximum(pp - sp * sp / n, 0.0), "bb": np.maximum(qq - sq * sq / n, 0.0), "ab": pq - sp * sq / n}
            self.made[a, b] = out
        return self.made[a, b][d]

    def std(self, name: str, d: int) -> np.ndarray:
        m = self.moments(name, d)
        return np.where(m["n"] >= 2, np.sqrt(m["aa"] / (m["n"] - 1)), np.nan)


def _regression(s: Sums, d: int, what: str) -> np.ndarray:
    """Slope, fit or residual of close on row position; missing for fewer than two points."""
    m, c = s.moments("close", d), s.own("close")
    slope = np.where(m["n"] >= 2, m["ab"] / m["bb"], np.nan)
    if what == "fit":
        return np.where(s.std("close", d) > LEAST_STD, slope * m["ab"] / m["aa"], np.nan)
    # positions count from the row itself, closes from its own close
    return (slope if what == "slope" else slope * m["mb"] - m["shift"]) / c


def _corr(s: Sums, d: int, x: str, y: str) -> np.ndarray:
    """Pearson correlation over rows where both are known; missing for fewer than two or a constant side."""
    m = s.moments(x, d, y)
    return m["ab"] / (np.sqrt(m["aa"]) * np.sqrt(m["bb"]))


def _share(s: Sums, d: int, name: str) -> np.ndarray:
    return s.total(name, d) / np.minimum(s.place, d)


def _balance(s: Sums, d: int, x: str, sign: int) -> np.ndarray:
    """Share of rises (1), falls (-1), or their difference (0) in all movement."""
    rise, fall = s.total(x, d, "rise"), s.total(x, d, "fall")
    return (rise if sign > 0 else fall if sign < 0 else rise - fall) / (s.total(x, d, "amount") + EPS)


#: In catalog order; those without a function come from ``order_statistics``.
FAMILIES: dict[str, Callable[[Sums, int], np.ndarray] | None] = {
    "roc": lambda s, d: s.before("close", d) / s.own("close"),
    "ma": lambda s, d: s.moments("close", d)["ma"] / s.own("close"),
    "std": lambda s, d: s.std("close", d) / s.own("close"),
    "beta": lambda s, d: _regression(s, d, "slope"),
    "rsqr": lambda s, d: _regression(s, d, "fit"),
    "resi": lambda s, d: _regression(s, d, "rest"),
    "max": lambda s, d: s.extreme("high", d, True) / s.own("close"),
    "min": lambda s, d: s.extreme("low", d, False) / s.own("close"),
    "qtlu": None,
    "qtld": None,
    "rank": None,
    "rsv": lambda s, d: (s.own("close") - s.extreme("low", d, False)) / (s.extreme("high", d, True) - s.extreme("low", d, False) + EPS),
    "imax": None,
    "imin": None,
    "imxd": None,
    "corr": lambda s, d: _corr(s, d, "close", "lv"),
    "cord": lambda s, d: _corr(s, d, "cr", "vr"),
    "cntp": lambda s, d: _share(s, d, "up"),
    "cntn": lambda s, d: _share(s, d, "down"),
    "cntd": lambda s, d: _share(s, d, "up") - _share(s, d, "down"),
    "sump": lambda s, d: _balance(s, d, "dc", 1),
    "sumn": lambda s, d: _balance(s, d, "dc", -1),
    "sumd": lambda s, d: _balance(s, d, "dc", 0),
    "vma": lambda s, d: s.moments("v", d)["ma"] / (s.own("v") + EPS),
    "vstd": lambda s, d: s.std("v", d) / (s.own("v") + EPS),
    "wvma": lambda s, d: s.std("wv", d) / (s.moments("wv", d)["ma"] + EPS),
    "vsump": lambda s, d: _balance(s, d, "dv", 1),
    "vsumn": lambda s, d: _balance(s, d, "dv", -1),
    "vsumd": lambda s, d: _balance(s, d, "dv", 0),
}


def _frames(x: np.ndarray, place: np.ndarray, d: int) -> np.ndarray:
    """The frames of the last rows as rows of a matrix, the latest value last; NaN before a series starts.

    ``x`` has d - 1 rows more than ``place``, before them.
    """
    frames = np.lib.stride_tricks.sliding_window_view(x, d)
    return np.where(np.arange(d) < (d - np.minimum(place, d))[:, None], np.nan, frames)


def _quantile(ordered: np.ndarray, known: np.ndarray, share: float) -> np.ndarray:
    """Linear interpolation in rows sorted with NaN last."""
    at = share * np.maximum(known - 1, 0)
    low, row = np.floor(at).astype(np.int64), np.arange(len(ordered))
    a, b = ordered[row, low], ordered[row, np.ceil(at).astype(np.int64)]
    return a + (at - low) * (b - a)


def _extreme(frames: np.ndarray, place: np.ndarray, top: bool) -> np.ndarray:
    """1-based place of the first extreme in each frame; a NaN in the frame is the extreme."""
    d = frames.shape[1]
    before = d - np.minimum(place, d)
    filled = np.where(np.arange(d) < before[:, None], -np.inf if top else np.inf, frames)
    return (filled.argmax(1) if top else filled.argmin(1)) - before + 1.0


def order_statistics(close: np.ndarray, high: np.ndarray, low: np.ndarray, place: np.ndarray, families: list[str], d: int) -> dict[str, np.ndarray]:
    """The families that need the order of a frame's values, for rows side by side in order of (series, date); NaN is missing.

    ``place`` is each row's number in its series; the values have d - 1 rows more, before these.  Frames are sorted once for both quantiles.
    """
    own, frames, made = close[d - 1 :], _frames(close, place, d), {}
    known = (~np.isnan(frames)).sum(1)
    if {"qtlu", "qtld"} & set(families):
        ordered = np.sort(frames, 1)
        made |= {"qtlu": _quantile(ordered, known, 0.8) / own, "qtld": _quantile(ordered, known, 0.2) / own}
    if "rank" in families:
        made["rank"] = np.where(np.isnan(own), np.nan, ((frames < own[:, None]).sum(1) + ((frames == own[:, None]).sum(1) + 1) / 2) / known)
    if {"imax", "imin", "imxd"} & set(families):
        top, bottom = _extreme(_frames(high, place, d), place, True), _extreme(_frames(low, place, d), place, False)
        made |= {"imax": top / d, "imin": bottom / d, "imxd": (top - bottom) / d}
    return {f: made[f] for f in families}


#: What the families are made of.
BASE = ("close", "high", "low", "v", "lv", "cr", "vr", "dc", "dv", "wv", "up", "down")


def packed_bytes(x: np.ndarray) -> pa.Array:
    """The rows of a matrix as bytes, one value each."""
    size = x.shape[1] * x.itemsize
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(0, len(x) * size + 1, size, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(x))])


def _rolled(families: list[str], windows: tuple[int, ...], names: list[str], packed: tuple[str, ...] = ()):
    """Batches of rows in order of (security, date) with those families; the last rows of a batch are kept for the next one's frames.

    Of ``packed`` the doubles of a row go as one value ``x``, NaN for NULL.
    """
    reach = max(windows)
    by_order = [f for f in families if FAMILIES[f] is None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail, seen, last = np.full((len(BASE), reach), np.nan), np.zeros((len(BASE), reach), bool), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in BASE])
            known = np.stack([batch.column(c).is_valid().to_numpy(zero_copy_only=False) for c in BASE])
            place = batch.column("rn").to_numpy().astype(np.int64)
            if not ((place == 1) | (place == np.concatenate([[last], place[:-1]]) + 1)).all():
                raise ValueError("rows are not in order of (security, date)")
            x, known, last, new = np.concatenate([tail, x], 1), np.concatenate([seen, known], 1), int(place[-1]), {}
            sums = Sums(dict(zip(BASE, x, strict=True)), dict(zip(BASE, known, strict=True)), place, windows, reach)
            with np.errstate(all="ignore"):
                for d in windows:
                    new |= {f"{f}{d}": FAMILIES[f](sums, d) for f in families if f not in by_order}
                    new |= {f"{f}{d}": v for f, v in order_statistics(*x[:3, reach - d + 1 :], place, by_order, d).items()}
            tail, seen = x[:, x.shape[1] - reach :], known[:, x.shape[1] - reach :]
            if packed:
                values = np.stack([new[n] if n in new else batch.column(n).to_numpy(zero_copy_only=False) for n in packed], 1).astype(np.float64)
                values[~np.isfinite(values)] = np.nan
                made = {"x": packed_bytes(values)}
            else:
                made = {n: pa.array(np.where(np.isfinite(v), v, np.nan), from_pandas=True) for n, v in new.items()}
            yield pa.RecordBatch.from_arrays([made[n] if n in made else batch.column(n) for n in names], names=names)

    return run


def rolling_features(panel: DataFrame, families: list[str] | None = None, windows: tuple[int, ...] = WINDOWS, carry: tuple[str, ...] = (), packed: tuple[str, ...] | None = None) -> DataFrame:
    """``trade_date, security_id``, the columns to ``carry``, and ``<family><d>`` for each family and window, in catalog order.

    With ``packed``, doubles among the columns to carry, those and all families are one column ``x`` (see ``wide``) in their place: many columns cost more on their way than in their making.

    A window of nothing but one row has no deviation, slope or correlation (NULL).  On a
    constant window CORR and CORD are NULL.  Keys must be unique per security.  Spark shuffles and sorts the rows; frames are summed and
    sorted in Arrow batches, in the order that the windows leave (and that is checked): a window column sums each frame anew, with
    125 rows a column of five windows.
    """
    keys, chosen = ("trade_date", "security_id", *carry), list(families or FAMILIES)
    rows = prepared(panel, *carry).select(*keys, "rn", *BASE)
    names, inside = [*keys, *(f"{f}{d}" for f in chosen for d in windows)], ()
    if packed is not None:
        inside = tuple(n for n in names if n in packed or n not in keys)
        names = [*(n for n in names if n not in inside), "x"]
    kind = T.DoubleType() if packed is None else T.BinaryType()
    schema = T.StructType([rows.schema[n] if n in rows.columns else T.StructField(n, kind) for n in names])
    return rows.mapInArrow(_rolled(chosen, windows, names, inside), schema)


def feature_names() -> list[str]:
    """The 158 features in catalog order."""
    return [*candles(), *(f"{f}{d}" for f in FAMILIES for d in WINDOWS)]


def all_features(panel: DataFrame, carry: tuple[str, ...] = (), packed: bool = False) -> DataFrame:
    """The whole set: 13 row ratios and 145 rolling features, with one shuffle by security; columns to ``carry`` come before them.

    ``packed``: as one column ``x`` of their doubles, in catalog order.
    """
    ratios = {n: clean(x) for n, x in candles().items()}
    return rolling_features(panel.withColumns(ratios), carry=(*carry, *ratios), packed=tuple(ratios) if packed else None)
