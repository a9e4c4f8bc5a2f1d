"""Point-in-time panel and forward open-to-open labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.core import series
from tidepanel.operators.contracts import ContractError

KEYS = ["trade_date", "security_id"]


def research_panel(daily: DataFrame, members: DataFrame, tradable: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Members' rows with the authoritative ``tradable_next_open`` (missing: false) and ``basic_eligible``.

    Joins sort by security first, as series are read in that order and a date has far more rows than a security.
    """
    by = ["security_id", "trade_date"]
    rows = daily.drop("tradable_next_open", "basic_eligible").join(members.select(*KEYS), by, "left_semi")
    rest = [c for c in rows.columns if c not in KEYS]
    rows = rows.join(tradable.select(*KEYS, "tradable_next_open"), by, "left").select(*KEYS, *rest, F.coalesce("tradable_next_open", F.lit(False)).alias("tradable_next_open"))
    rows = rows.withColumn("basic_eligible", F.lit(True))
    if start:
        rows = rows.where(F.col("trade_date") >= F.lit(start).cast("date"))
    if end:
        rows = rows.where(F.col("trade_date") <= F.lit(end).cast("date"))
    return rows


def _valid(x: Column) -> Column:
    return F.coalesce((x > 0) & (x < float("inf")) & ~F.isnan(x), F.lit(False))


def forward_labels(panel: DataFrame, benchmark: DataFrame, horizons: tuple[int, ...] = (1, 5, 20)) -> DataFrame:
    """``label_excess_o2o_<h>d``, ``label_end_date_<h>d``, ``entry_date`` and a tightened ``basic_eligible``.

    Entry is the next row's open, exit the (h + 1)th row's.  A label needs four finite positive opens, and
    the security's entry and end dates to be the benchmark's.  The benchmark is one series: a row per session.
    """
    if not horizons or sorted(set(horizons)) != sorted(horizons) or min(horizons) < 1:
        raise ContractError("horizons are distinct positive numbers")
    s, b = series(), Window.orderBy("trade_date")
    lead = lambda c, k, w: F.lead(c, k).over(w)
    ends = [x for h in horizons for x in (lead("trade_date", h + 1, s).alias(f"label_end_date_{h}d"), lead("adjusted_open", h + 1, s).alias(f"_exit{h}"))]
    own = panel.select("*", lead("trade_date", 1, s).alias("entry_date"), lead("adjusted_open", 1, s).alias("_entry"), *ends)
    bench_ends = [x for h in horizons for x in (lead("trade_date", h + 1, b).alias(f"_bend{h}"), lead("adjusted_open", h + 1, b).alias(f"_bexit{h}"))]
    market = benchmark.select("trade_date", lead("trade_date", 1, b).alias("_bdate"), lead("adjusted_open", 1, b).alias("_bentry"), *bench_ends)
    both = own.join(F.broadcast(market), "trade_date", "left")

    def ok(h: int) -> Column:
        opens = [_valid(F.col(c)) for c in ("_entry", f"_exit{h}", "_bentry", f"_bexit{h}")]
        dates = (F.col("entry_date") == F.col("_bdate")) & (F.col(f"label_end_date_{h}d") == F.col(f"_bend{h}"))
        return opens[0] & opens[1] & opens[2] & opens[3] & F.coalesce(dates, F.lit(False))

    labels = {f"label_excess_o2o_{h}d": F.when(ok(h), (F.col(f"_exit{h}") / F.col("_entry") - 1) - (F.col(f"_bexit{h}") / F.col("_bentry") - 1)) for h in horizons}
    kept = [c for c in panel.columns if c != "basic_eligible"]
    basic = (F.coalesce("basic_eligible", F.lit(False)) if "basic_eligible" in panel.columns else F.lit(True)) & ok(horizons[0])
    return both.select(*kept, basic.alias("basic_eligible"), "entry_date", *(f"label_end_date_{h}d" for h in horizons), *(x.alias(n) for n, x in labels.items()))


def intervals_members(daily: DataFrame, spells: DataFrame) -> DataFrame:
    """Rows inside a membership spell ``security_id, since, until`` (until open-ended and exclusive)."""
    d, m = daily.alias("d"), spells.alias("m")
    inside = (F.col("d.security_id") == F.col("m.security_id")) & (F.col("d.trade_date") >= F.col("m.since")) & (F.col("m.until").isNull() | (F.col("d.trade_date") < F.col("m.until")))
    return d.join(m, inside, "left_semi")


def signal_calendar(dates: DataFrame, unit: str = "week") -> DataFrame:
    """Per ``unit`` the last session; entry is the session after, exit the session after the next signal's entry."""
    b = Window.orderBy("trade_date")
    sessions = dates.select("trade_date").distinct().select("trade_date", F.lead("trade_date").over(b).alias("entry_date"))
    last = sessions.groupBy(F.date_trunc(unit, "trade_date").alias("_u")).agg(F.max_by(F.struct("trade_date", "entry_date"), "trade_date").alias("s")).select("s.*")
    return last.select(F.col("trade_date").alias("signal_date"), "entry_date", F.lead("entry_date").over(b).alias("exit_date"))


def weekly_labels(panel: DataFrame, calendar: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Excess open-to-open return from entry to exit, per signal date and security."""
    opens = panel.select("security_id", F.col("trade_date").alias("_d"), F.col("adjusted_open").alias("_o"))
    market = benchmark.select(F.col("trade_date").alias("_d"), F.col("adjusted_open").alias("_b"))
    cal = F.broadcast(calendar.where("exit_date is not null"))
    at = lambda c, o, b: opens.join(cal, opens["_d"] == F.col(c)).join(F.broadcast(market), "_d").select("signal_date", "security_id", F.col("_o").alias(o), F.col("_b").alias(b))
    both = at("entry_date", "o1", "b1").join(at("exit_date", "o2", "b2"), ["signal_date", "security_id"])
    return both.select("signal_date", "security_id", ((F.col("o2") / F.col("o1") - 1) - (F.col("b2") / F.col("b1") - 1)).alias("target_excess_return"))


def as_of(panel: DataFrame, calendar: DataFrame, value: str, sessions: int) -> DataFrame:
    """Latest known ``value`` of each security within ``sessions`` sessions up to each signal date."""
    order = Window.orderBy("trade_date")
    numbered = panel.select("trade_date").distinct().withColumn("n", F.row_number().over(order))
    rows = panel.where(F.col(value).isNotNull()).join(F.broadcast(numbered), "trade_date").select("security_id", "n", value)
    signals = calendar.select(F.col("signal_date").alias("trade_date")).join(numbered, "trade_date").select(F.col("trade_date").alias("signal_date"), F.col("n").alias("at"))
    # a row per signal and session in its reach: rows that no signal reaches fall out, none is copied but for signals that it serves
    reach = signals.select("signal_date", "at", F.explode(F.sequence(F.col("at") - sessions, F.col("at"))).alias("n"))
    found = rows.join(F.broadcast(reach), "n")
    return found.groupBy("signal_date", "security_id").agg(F.max_by(value, "n").alias(value), (F.first("at") - F.max("n")).alias("age"))


def enough_history(panel: DataFrame, rows: int = 61) -> DataFrame:
    """Rows that have at least ``rows`` complete rows of their series up to them."""
    complete = F.count(F.when(F.col("adjusted_open").isNotNull() & F.col("adjusted_close").isNotNull() & F.col("volume").isNotNull(), 1))
    return panel.withColumn("_n", complete.over(series().rowsBetween(Window.unboundedPreceding, 0))).where(F.col("_n") >= rows).drop("_n")


def base_adjusted(panel: DataFrame) -> DataFrame:
    """Prices over, and volume times, the first close of the series."""
    first = F.first("adjusted_close").over(series().rowsBetween(Window.unboundedPreceding, 0))
    return panel.select(*KEYS, *((F.col(f"adjusted_{c}") / first).alias(c) for c in ("open", "high", "low", "close")), (F.col("volume") * first).alias("volume"))


def fold_assignments(panel: DataFrame, folds: DataFrame) -> DataFrame:
    """``fold, role`` of each row by year; train and validation rows whose label ends in the next role's span are purged.

    ``folds(fold, train_from, train_to, validation, test)`` are years.  A row may be in many folds.
    """
    y = F.year("signal_date")
    role = F.when(y.between(F.col("train_from"), F.col("train_to")), "train").when(y == F.col("validation"), "validation").when(y == F.col("test"), "test")
    rows = panel.join(F.broadcast(folds), y.between(F.col("train_from"), F.col("test"))).withColumn("role", role).where("role is not null")
    end = F.year("label_end_date")
    purged = F.when(F.col("role") == "train", end >= F.col("validation")).when(F.col("role") == "validation", end >= F.col("test")).otherwise(F.lit(False))
    return rows.where(F.coalesce(~purged, F.lit(False))).drop("train_from", "train_to", "validation", "test")


def parity(a: DataFrame, b: DataFrame, keys: list[str], value: str, tolerance: float = 1e-6) -> DataFrame:
    """One row: keys in both, in one only, and values apart by more than the tolerance."""
    x, y = a.select(*keys, F.col(value).alias("x")), b.select(*keys, F.col(value).alias("y"))
    j = x.withColumn("_a", F.lit(1)).join(y.withColumn("_b", F.lit(1)), keys, "full")
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return j.agg(F.count_if(both).alias("both"), F.count_if(F.col("_b").isNull()).alias("left_only"), F.count_if(F.col("_a").isNull()).alias("right_only"), F.count_if(both & (F.abs(F.col("x") - F.col("y")) > tolerance)).alias("apart"))
