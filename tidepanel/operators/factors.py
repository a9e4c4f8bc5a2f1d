"""Ten daily factors: panel to ``trade_date, security_id, raw_value``.

Lags and frames count rows of the panel given, so membership is applied before.  A factor is NULL until its
whole lookback is there.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepanel.functions.core import frame, sdiv, series
from tidepanel.operators.contracts import ContractError, require_columns

def close() -> Column:
    return F.col("adjusted_close")


def back(k: int) -> Column:
    return F.lag("adjusted_close", k).over(series())


RET = "ret"


def _full(n: int, x: str, value: Column, d: int) -> Column:
    return F.when(F.count(x).over(frame(d)) == n, value)


def _idio() -> Column:
    w = frame(20)
    both = F.col(RET).isNotNull() & F.col("market_return").isNotNull()
    y, x = F.when(both, F.col(RET)), F.when(both, F.col("market_return"))
    sxx, syy, sxy = F.var_pop(x).over(w), F.var_pop(y).over(w), F.covar_pop(x, y).over(w)
    rest = F.greatest(syy - sdiv(sxy * sxy, sxx), F.lit(0.0))
    return F.when((F.count(x).over(w) == 20) & (sxx > 0), F.sqrt(rest))


def _pv_corr() -> Column:
    w = frame(20)
    lv = F.when(F.col("volume") > 0, F.ln(F.col("volume").cast("double")))
    both = F.col(RET).isNotNull() & lv.isNotNull()
    x, y = F.when(both, F.col(RET)), F.when(both, lv)
    corr = sdiv(F.covar_pop(x, y).over(w), F.stddev_pop(x).over(w) * F.stddev_pop(y).over(w))
    return F.when(F.count(x).over(w) == 20, corr)


def _volume_surprise() -> Column:
    w = series().rowsBetween(-20, -1)
    mean = F.when(F.count("volume").over(w) == 20, F.avg("volume").over(w))
    return F.when(mean > 0, sdiv(F.col("volume"), mean))


def _close_position() -> Column:
    w = frame(5)
    high, low = F.max("adjusted_high").over(w), F.min("adjusted_low").over(w)
    full = (F.count("adjusted_high").over(w) == 5) & (F.count("adjusted_low").over(w) == 5) & (high > low)
    return F.when(full, sdiv(close() - low, high - low))


@dataclass(frozen=True)
class Factor:
    """Direction, needed columns, formula text, and the value."""

    direction: str
    fields: tuple[str, ...]
    formula: str
    value: Callable[[], Column]


P = "adjusted_close"
FACTORS: dict[str, Factor] = {
    "REV5": Factor("negative", (P,), "close[t] / close[t-5] - 1", lambda: sdiv(close(), back(5)) - 1),
    "MOM20": Factor("positive", (P,), "close[t] / close[t-20] - 1", lambda: sdiv(close(), back(20)) - 1),
    "MOM60": Factor("positive", (P,), "close[t] / close[t-60] - 1", lambda: sdiv(close(), back(60)) - 1),
    "VOL20": Factor("negative", (P,), "population std of returns over 20 sessions", lambda: _full(20, RET, F.stddev_pop(RET).over(frame(20)), 20)),
    "IDIOVOL20": Factor("negative", (P, "market_return"), "residual std of return on market over 20 sessions", _idio),
    "TURN20": Factor("negative", ("turnover",), "mean turnover over 20 sessions", lambda: _full(20, "turnover", F.avg("turnover").over(frame(20)), 20)),
    "VOLSURP20": Factor("positive", ("volume",), "volume over mean of the 20 sessions before", _volume_surprise),
    "AMIHUD20": Factor("positive", (P, "traded_amount"), "mean of |return| / amount over 20 sessions", lambda: _full(20, "illiquid", F.avg("illiquid").over(frame(20)), 20)),
    "PV_CORR20": Factor("positive", (P, "volume"), "correlation of return and ln volume over 20 sessions", _pv_corr),
    "CLOSE_POS5": Factor("positive", (P, "adjusted_high", "adjusted_low"), "close in the range of 5 sessions", _close_position),
}


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, f.direction, ";".join(f.fields), f.formula) for k, f in FACTORS.items()], "factor_id string, direction string, required_fields string, formula string")


def lookup(factor_id: str) -> Factor:
    if factor_id not in FACTORS:
        raise ContractError(f"unknown factor {factor_id}")
    return FACTORS[factor_id]


def lookback(rows: DataFrame) -> DataFrame:
    """Most sessions that each formula text looks back."""
    numbers = F.transform(F.concat(F.regexp_extract_all("formula", F.lit(r"t-(\d+)"), 1), F.regexp_extract_all("formula", F.lit(r"(\d+) sessions"), 1)), lambda x: x.cast("int"))
    return rows.select("factor_id", F.coalesce(F.array_max(numbers), F.lit(0)).alias("sessions"))


def compute(panel: DataFrame, factor_id: str) -> DataFrame:
    factor = lookup(factor_id)
    require_columns(panel, ["trade_date", "security_id", *factor.fields])
    rows = panel
    if P in factor.fields:
        rows = rows.withColumn(RET, sdiv(close(), back(1)) - 1)
    if factor_id == "AMIHUD20":
        rows = rows.withColumn("illiquid", sdiv(F.abs(RET), F.when(F.col("traded_amount") > 0, F.col("traded_amount"))))
    return rows.select("trade_date", "security_id", factor.value().alias("raw_value"))


def leak_free(panel: DataFrame, end: str | None = None) -> DataFrame:
    """No label or future columns, no rows after ``end``."""
    future = [c for c in panel.columns if c.startswith(("label_", "future_", "entry_", "target_")) or c in ("basic_eligible", "tradable_next_open")]
    rows = panel.drop(*future)
    return rows.where(F.col("trade_date") <= F.lit(end).cast("date")) if end else rows


def history_start(panel: DataFrame, start: str, sessions: int) -> DataFrame:
    """The date ``sessions`` sessions before ``start`` (the first date, if there are fewer)."""
    dates = panel.select("trade_date").distinct().where(F.col("trade_date") < F.lit(start).cast("date"))
    rn = F.row_number().over(Window.orderBy(F.desc("trade_date")))
    return dates.select("trade_date", rn.alias("rn")).where(F.col("rn") <= max(1, sessions)).agg(F.min("trade_date").alias("trade_date"))


def label_end(bench: DataFrame, end: str, horizon: int) -> DataFrame:
    """The date horizon + 1 sessions after ``end`` on the benchmark's calendar (the last date, if there are fewer)."""
    rn = F.row_number().over(Window.orderBy("trade_date"))
    return bench.where(F.col("trade_date") > F.lit(end).cast("date")).select("trade_date", rn.alias("rn")).where(F.col("rn") <= horizon + 1).agg(F.max("trade_date").alias("trade_date"))
