"""Statistics of per-date series: IC summaries, autocorrelation-robust tests, decisions."""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.functions.core import clean, sdiv
from tidepanel.operators.contracts import ContractError


@F.pandas_udf(T.DoubleType())
def upper_tail(t: pd.Series) -> pd.Series:
    """P(N > t), on summary rows only."""
    return t.map(lambda x: None if x is None or x != x else 0.5 * math.erfc(x / math.sqrt(2)))


def _listed(value: str, date: str, lag: Column | int) -> list[Column]:
    """Aggregates of a series for ``_tested``: count, mean, wished lag, and the known values in order of date."""
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(date).alias("d"), F.col(value).alias("v")))
    return [F.count(value).alias("_n"), F.avg(value).alias("_mean"), F.first(F.lit(lag) if isinstance(lag, int) else lag).alias("_lag"), F.array_sort(F.collect_list(known)).alias("_s")]


def _tested(series: DataFrame, kept: list[str], unbiased: bool) -> DataFrame:
    """``kept, n, mean, se, t_stat`` from the aggregates of ``_listed``; all NULL but n for a series without values."""
    rows = series.withColumn("_e", F.transform("_s", lambda x: x["v"] - F.col("_mean"))).withColumn("_l", F.least(F.col("_lag"), F.col("_n") - 1).cast("int"))

    def term(k: Column) -> Column:
        rest = F.size("_e") - k
        products = F.zip_with(F.slice("_e", F.lit(1), rest), F.slice("_e", k + 1, rest), lambda x, y: x * y)
        weight = F.when(k == 0, 1.0).otherwise(2 * (1 - k / (F.col("_l") + 1.0)))
        return F.aggregate(products, F.lit(0.0), lambda x, y: x + y) / (F.col("_n") - k if unbiased else F.col("_n")) * weight

    total = F.aggregate(F.transform(F.sequence(F.lit(0), F.col("_l")), term), F.lit(0.0), lambda x, y: x + y)
    rows = rows.withColumn("se", F.when(F.col("_n") > 0, F.sqrt(F.greatest(total, F.lit(0.0)) / F.col("_n"))))
    inf = F.when(F.col("_mean") > 0, F.lit(float("inf"))).when(F.col("_mean") < 0, F.lit(float("-inf")))
    t = sdiv(F.col("_mean"), F.col("se"))
    return rows.select(*kept, F.col("_n").alias("n"), F.col("_mean").alias("mean"), "se", (t if unbiased else F.when(F.col("se") == 0, inf).otherwise(t)).alias("t_stat"))


def mean_test(series: DataFrame, value: str, by: list[str], date: str, lag: Column | int, unbiased: bool = False) -> DataFrame:
    """Mean of each series with a Bartlett-weighted long-run error: ``n, mean, se, t_stat``.

    ``lag`` is a number or a column of the group.  The default divides autocovariances by n and clamps the lag
    to n - 1; ``unbiased`` takes means over n - k terms and has no t where the error is 0.
    A series has a value per date, thousands at most, so one list holds it and the input is read once.
    """
    return _tested(series.where(F.col(value).isNotNull()).groupBy(*by).agg(*_listed(value, date, lag)), by, unbiased)


def ic_statistics(series: DataFrame, value: str, by: list[str]) -> DataFrame:
    """``n, mean, std, icir, positive_ratio``; std and ratio NULL below two values."""
    out = series.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.avg((F.col(value) > 0).cast("double")).alias("positive_ratio"))
    return out.withColumn("icir", sdiv(F.col("mean"), F.col("std")))


def ic_by_year(series: DataFrame, value: str, date: str, by: list[str]) -> DataFrame:
    """The same over the full sample (``year`` NULL) and each year, in one pass of grouping sets."""
    rows = series.where(F.col(value).isNotNull()).withColumn("year", F.year(date))
    sets = [[F.col(c) for c in by], [*(F.col(c) for c in by), F.col("year")]]
    out = rows.groupingSets(sets, *(F.col(c) for c in by), F.col("year")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.avg((F.col(value) > 0).cast("double")).alias("positive_ratio"))
    return out.withColumn("icir", sdiv(F.col("mean"), F.col("std")))


def _half(c: str) -> list[Column]:
    x = F.col(f"{c}_ic")
    return [F.avg(x).alias(f"mean_{c}_ic"), F.stddev_samp(x).alias(f"{c}_ic_std"), sdiv(F.avg(x), F.stddev_samp(x)).alias(f"{c}_icir"), F.avg((x > 0).cast("double")).alias(f"positive_{c}_ic_ratio"), F.sum(x).alias(f"cumulative_{c}_ic")]


def ic_summary(daily: DataFrame, overlap: bool = True, date: str = "trade_date") -> DataFrame:
    """Pearson and rank statistics per eligibility and horizon, with the robust test of the rank IC's mean; one pass."""
    by = ["eligibility", "horizon_days"]
    lag = F.col("horizon_days") - 1 if overlap else 0
    table = daily.groupBy(*by).agg(F.count("rank_ic").alias("n_observations"), *_half("pearson"), *_half("rank"), *_listed("rank_ic", date, lag))
    names = [c for c in table.columns if not c.startswith("_")]
    out = _tested(table, names, False).drop("n", "mean").withColumnsRenamed({"se": "hac_standard_error", "t_stat": "hac_t_stat"})
    return out.withColumn("hac_lag", (F.col("horizon_days") - 1 if overlap else F.lit(0)).cast("int"))


def with_p_value(summary: DataFrame, t: str = "hac_t_stat") -> DataFrame:
    """The one-sided normal p-value of a statistic: a row per series, so a Python map serves."""
    return summary.withColumn("hac_one_sided_p_value", upper_tail(F.col(t)))


def ic_yearly(daily: DataFrame, date: str = "trade_date") -> DataFrame:
    return daily.groupBy("eligibility", "horizon_days", F.year(date).alias("year")).agg(F.count("rank_ic").alias("n_observations"), *_half("pearson"), *_half("rank"))


def every_hth(daily: DataFrame, date: str = "trade_date") -> DataFrame:
    """Every h-th date of the series of horizons above one."""
    rn = F.row_number().over(Window.partitionBy("eligibility", "horizon_days").orderBy(date))
    return daily.where("horizon_days > 1").withColumn("_r", rn).where((F.col("_r") - 1) % F.col("horizon_days") == 0).drop("_r")


def decide(daily: DataFrame, years: list[int], least: int = 500, date: str = "trade_date") -> DataFrame:
    """One row: ``decision`` Admit, Review or Reject from the 1-day rank IC of the locked years; one pass over the series."""
    locked = daily.where((F.col("horizon_days") == 1) & F.year(date).isin(years))
    of_year = [F.avg(F.when(F.year(date) == y, F.col("rank_ic"))).alias(f"_y{y}") for y in years]
    table = locked.groupBy("eligibility").agg(*_listed("rank_ic", date, 0), *of_year)
    s = with_p_value(_tested(table, ["eligibility", *(f"_y{y}" for y in years)], False), "t_stat")
    at = lambda kind, c: F.max(F.when(F.col("eligibility") == kind, c if isinstance(c, Column) else F.col(c)))
    good = sum((F.coalesce(F.col(f"_y{y}") > 0, F.lit(False)).cast("long") for y in years), F.lit(0).cast("long"))
    j = s.agg(at("basic", "n").alias("n"), at("basic", "mean").alias("mean"), at("basic", "t_stat").alias("t_stat"), at("basic", "hac_one_sided_p_value").alias("p"), at("tradable", "mean").alias("tradable_mean"), F.coalesce(at("basic", good), F.lit(0).cast("long")).alias("good_years"))
    admit = (F.col("p") < 0.05) & (F.col("good_years") >= 4) & (F.col("tradable_mean") > 0)
    decision = F.when(F.coalesce(F.col("n"), F.lit(0)) < least, "Reject").when(F.col("mean") < 0, "Reject").when(F.col("mean").isNull() | (F.col("mean") == 0), "Review").when(F.coalesce(admit, F.lit(False)), "Admit").otherwise("Review")
    return j.withColumn("decision", decision)


def paired_difference(series: DataFrame, model: str, a: str, b: str, value: str, date: str, lag: int = 4) -> DataFrame:
    """Test of the mean of model a's series less model b's on the same dates."""
    at = lambda m: F.max(F.when(F.col(model) == m, F.col(value)))
    diff = series.groupBy(date).agg((at(a) - at(b)).alias("difference")).withColumn("pair", F.lit(f"{a}-{b}"))
    return mean_test(diff, "difference", ["pair"], date, lag, unbiased=True)


def best_candidates(candidates: DataFrame, fold: str = "fold") -> DataFrame:
    """Per fold the candidate of highest mean IC, then ICIR, then alpha."""
    order = Window.partitionBy(fold).orderBy(F.desc("mean_rank_ic"), F.desc("rank_icir"), F.desc("alpha"))
    return candidates.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def data_quality(panel: DataFrame, date: str = "trade_date") -> DataFrame:
    """``metric, value`` of a research panel, in one scan."""
    checks = {"rows": F.count("*"), "dates": F.countDistinct(date), "securities": F.countDistinct("security_id"), "missing_open": F.count_if(F.col("adjusted_open").isNull()), "missing_close": F.count_if(F.col("adjusted_close").isNull()), "tradable_rows": F.count_if("tradable_next_open")}
    return panel.agg(*(x.cast("long").alias(n) for n, x in checks.items())).unpivot([], list(checks), "metric", "value")


def run_quality(panel: DataFrame, horizons: tuple[int, ...], date: str = "trade_date") -> DataFrame:
    """``metric, value`` of a run's evidence panel: rows, dates, securities, eligibility, finite scores and labels; one scan."""
    checks = {"panel_rows": F.count("*"), "signal_dates": F.countDistinct(date), "security_ids": F.countDistinct("security_id"), "basic_eligible_rows": F.count_if("basic_eligible"), "tradable_next_open_rows": F.count_if("tradable_next_open")}
    checks |= {"finite_directed_score_rows": F.count(clean(F.col("directed_score")))}
    checks |= {f"finite_label_{h}d_rows": F.count(clean(F.col(f"label_excess_o2o_{h}d"))) for h in horizons}
    return panel.agg(*(x.cast("long").alias(n) for n, x in checks.items())).unpivot([], list(checks), "metric", "value")


def cumulative_rank_ic(daily: DataFrame, date: str = "trade_date") -> DataFrame:
    w = Window.partitionBy("eligibility", "horizon_days").orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    return daily.select(date, "eligibility", "horizon_days", F.sum(F.coalesce("rank_ic", F.lit(0.0))).over(w).alias("cumulative_rank_ic"))


def tagged_union(tables: dict[str, DataFrame], tag: str) -> DataFrame:
    """Tables of different columns under one another, with their name in ``tag``."""
    out = None
    for name, table in tables.items():
        t = table.withColumn(tag, F.lit(name))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out


#: The metrics that a scoreboard row holds.
IC_METRICS = ("n_observations", "mean_pearson_ic", "pearson_icir", "mean_rank_ic", "rank_icir", "hac_t_stat", "hac_one_sided_p_value")
PORTFOLIO_METRICS = ("annualized_return", "volatility", "sharpe", "max_drawdown", "n_periods", "n_evaluable_periods")


def scoreboard_row(summary: DataFrame, portfolios: DataFrame, run: list[str], horizons: tuple[int, ...] = (1, 5, 20)) -> DataFrame:
    """One wide row per run: IC metrics by eligibility and horizon, top-k metrics by return type and horizon, and turnover.

    A horizon that the tables lack is NULL; gross and net rows share one turnover (``contracts.same_turnover`` tells).
    """
    at = lambda cond, c, name: F.max(F.when(cond, F.col(c))).alias(name)
    ic = [
        at((F.col("eligibility") == kind) & (F.col("horizon_days") == h), m, f"{prefix}{m}_{h}d")
        for h in horizons for kind, prefix in (("basic", ""), ("tradable", "tradable_")) for m in IC_METRICS
    ]
    book = portfolios.where("portfolio_kind = 'top_k_long' and not is_diagnostic")
    pf = [
        at((F.col("return_type") == kind) & (F.col("horizon_days") == h), m, f"top_k_{kind}_{m}_{h}d")
        for h in horizons for kind in ("gross", "net") for m in PORTFOLIO_METRICS
    ] + [at(F.col("horizon_days") == h, "mean_turnover", f"top_k_mean_turnover_{h}d") for h in horizons]
    return summary.groupBy(*run).agg(*ic).join(book.groupBy(*run).agg(*pf), run, "left")


def latest_runs(scoreboard: DataFrame) -> DataFrame:
    """The latest formal run of each factor; ties by run id.  A formal run whose ``created_at`` is no time is refused."""
    formal = scoreboard.where("run_type = 'formal'").withColumn("_t", F.expr("try_cast(created_at AS timestamp)"))
    if bad := formal.where("_t is null").select("factor_id", "run_id", "created_at").limit(1).collect():
        raise ContractError(f"no time of creation: {bad[0]}")
    order = Window.partitionBy("factor_id").orderBy(F.desc("_t"), F.desc("run_id"))
    return formal.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r", "_t")


def factor_cards(scoreboard: DataFrame) -> DataFrame:
    """The tables of each factor's card: its latest formal run as ``factor_id, run_id, part, horizon_days, kind, metric, value``.

    The wide row is turned by the rule of its names: ``[tradable_]<metric>_<h>d`` is part ``ic`` of kind basic or tradable,
    ``top_k_<gross or net>_<metric>_<h>d`` part ``portfolio``, ``top_k_<metric>_<h>d`` part ``portfolio`` of kind both.  Other columns are left out.
    """
    latest = latest_runs(scoreboard)
    found = {c: m for c in latest.columns if (m := re.fullmatch(r"(top_k_)?(gross_|net_|tradable_)?(.+)_(\d+)d", c))}
    turned = []
    for c, m in found.items():
        kind = (m[2] or ("both_" if m[1] else "basic_"))[:-1]
        turned.append(F.struct(F.lit("portfolio" if m[1] else "ic").alias("part"), F.lit(int(m[4])).alias("horizon_days"), F.lit(kind).alias("kind"), F.lit(m[3]).alias("metric"), F.col(c).cast("double").alias("value")))
    return latest.select("factor_id", "run_id", F.explode(F.array(*turned)).alias("c")).select("factor_id", "run_id", "c.*")
