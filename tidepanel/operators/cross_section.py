"""Operators on one date's cross section.

Statistics of a date are windows over its rows, one level after another on the same
partitioning: the input is read once and shuffled once by date, however many statistics follow.
A cross section is some thousands of rows; windows spill where it is larger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.core import avg_rank, avg_rank_of, clean, scorr, sdiv
from tidepanel.operators import wide
from tidepanel.operators.contracts import ContractError, valid_horizons
from tidepanel.operators.wide import CLIP, MAD

#: More features than this are cleaned by broadcast numbers of each date: a plan with windows for each takes longer to compile than to run.
WIDE = 24


def _doubles(panel: DataFrame, names: list[str]) -> DataFrame:
    return panel.select(*[F.col(c).cast("double").alias(c) if c in names else F.col(c) for c in panel.columns])


def preprocess(panel: DataFrame, names: list[str], date: str = "trade_date") -> DataFrame:
    """Each feature, per date: median fill, clip at 5 robust deviations (none if the MAD is 0), z-score.

    A feature without values or variance on a date is 0 there.  Medians ignore NULLs.  Few features cost one shuffle by date; of
    many, rows are not shuffled but read five times (see ``wide``), so they should be stored.
    """
    if len(names) > WIDE:
        return wide.preprocess(_doubles(panel, names), names, date)
    w = Window.partitionBy(date)
    rest = [c for c in panel.columns if c not in names]

    def level(rows: DataFrame, *made: dict[str, Column]) -> DataFrame:
        return rows.select(*rest, *(x.alias(n) for columns in made for n, x in columns.items()))

    same = {c: F.col(c) for c in names}
    rows = level(panel, {c: clean(F.col(c)) for c in names})
    rows = level(rows, same, {f"m_{c}": F.median(c).over(w) for c in names})
    rows = level(rows, {c: F.coalesce(F.col(c), F.col(f"m_{c}")) for c in names}, {f"m_{c}": F.col(f"m_{c}") for c in names})
    rows = level(rows, same, {f"m_{c}": F.col(f"m_{c}") for c in names}, {f"s_{c}": F.median(F.abs(F.col(c) - F.col(f"m_{c}"))).over(w) for c in names})

    def clipped(c: str) -> Column:
        x, m, s = F.col(c), F.col(f"m_{c}"), CLIP * MAD * F.col(f"s_{c}")
        return F.when(F.col(f"s_{c}") * MAD <= 1e-12, x).otherwise(F.greatest(m - s, F.least(m + s, x)))

    rows = level(rows, {c: clipped(c) for c in names})
    rows = level(rows, same, {f"a_{c}": F.avg(c).over(w) for c in names}, {f"d_{c}": F.stddev_pop(c).over(w) for c in names})
    z = lambda c: F.when(F.col(f"d_{c}") > 1e-12, (F.col(c) - F.col(f"a_{c}")) / F.col(f"d_{c}")).otherwise(0.0)
    return rows.select(*[z(c).alias(c) if c in names else F.col(c) for c in panel.columns])


def quality(panel: DataFrame, names: list[str], date: str = "trade_date") -> DataFrame:
    """Per (date, feature): what its cleaning met and left.

    Rows, finite values before, missing ones (infinite ones among them) and infinite ones, median, MAD, robust scale, the bounds of the clip, values
    beyond them, mean and deviation of the z-scores, finite values after, and flags for no variance and no value.
    The z-scores are those of ``preprocess``; all levels share one partitioning, or, for many features, come from five passes without a shuffle of rows.
    """
    by = [date, "feature"]
    scale = MAD * F.col("mad")
    lower, upper = F.col("median") - CLIP * scale, F.col("median") + CLIP * scale
    derived = {"robust_scale": scale, "winsor_lower": lower, "winsor_upper": upper, "missing_before": F.col("n_rows") - F.col("finite_before"), "all_null": F.col("finite_before") == 0}
    if len(names) > WIDE:
        return wide.quality(_doubles(panel.select(date, *names), names), names, date).withColumns(derived)
    w = Window.partitionBy(*by)
    long = panel.select(date, *(F.col(n).cast("double").alias(n) for n in names)).unpivot(date, names, "feature", "raw").withColumn("x", clean(F.col("raw")))
    long = long.withColumn("median", F.median("x").over(w)).withColumn("filled", F.coalesce("x", "median"))
    long = long.withColumn("mad", F.median(F.abs(F.col("filled") - F.col("median"))).over(w))
    spread = scale > 1e-12
    long = long.withColumn("held", F.when(spread, F.greatest(lower, F.least(upper, F.col("filled")))).otherwise(F.col("filled")))
    long = long.withColumn("_a", F.avg("held").over(w)).withColumn("_d", F.stddev_pop("held").over(w))
    long = long.withColumn("z", F.when(F.col("_d") > 1e-12, (F.col("held") - F.col("_a")) / F.col("_d")).otherwise(0.0))
    out = long.groupBy(*by).agg(
        F.count_if(spread & ((F.col("filled") < lower) | (F.col("filled") > upper))).alias("clipped_count"),
        F.count("*").alias("n_rows"),
        F.count("x").alias("finite_before"),
        F.count_if(F.abs("raw") == float("inf")).alias("infinite_before"),
        F.first("median").alias("median"),
        F.first("mad").alias("mad"),
        F.coalesce(F.first("_d") <= 1e-12, F.lit(True)).alias("zero_variance"),
        F.avg("z").alias("post_mean"),
        F.stddev_pop("z").alias("post_std"),
        F.count(clean(F.col("z"))).alias("finite_after"),
    )
    return out.withColumns(derived)


def prepare_factor(raw: DataFrame, direction: str, date: str = "trade_date") -> DataFrame:
    """``winsorized_value, zscore_value, directed_score, imputed``: median fill, MAD clip, z-score per date.

    A MAD of 0 clips everything to the median, so the z-score is NULL.  Fewer than two known values give NULL.
    Names whose factor is missing are imputed and keep a score; ``imputed`` marks them.
    """
    w = Window.partitionBy(date)
    rows = raw.withColumn("raw_value", clean(F.col("raw_value")))
    rows = rows.select("*", F.median("raw_value").over(w).alias("_m"), F.count("raw_value").over(w).alias("_n"))
    rows = rows.withColumn("_x", F.coalesce("raw_value", "_m"))
    rows = rows.withColumn("_s", F.median(F.abs(F.col("_x") - F.col("_m"))).over(w))
    bound = CLIP * MAD * F.col("_s")
    rows = rows.withColumn("winsorized_value", F.when(F.col("_n") >= 2, F.greatest(F.col("_m") - bound, F.least(F.col("_m") + bound, F.col("_x")))))
    rows = rows.select("*", F.avg("winsorized_value").over(w).alias("_a"), F.stddev_pop("winsorized_value").over(w).alias("_d"))
    z = F.when(F.col("_d") > 0, (F.col("winsorized_value") - F.col("_a")) / F.col("_d"))
    sign = 1.0 if direction == "positive" else -1.0
    return rows.select(*raw.columns, "winsorized_value", z.alias("zscore_value"), (z * sign).alias("directed_score"), F.col("raw_value").isNull().alias("imputed"))


def zscore_label(panel: DataFrame, label: str, date: str, fail: bool = False) -> DataFrame:
    """``label_z`` per date; where a date has no variation NULL, or with ``fail`` an error."""
    w = Window.partitionBy(date)
    rows = panel.select("*", F.avg(label).over(w).alias("_a"), F.stddev_pop(label).over(w).alias("_d"))
    if fail and (bad := rows.where("_d is null or _d <= 0").select(date).limit(1).collect()):
        raise ContractError(f"the label has no variation on {bad[0][0]}")
    return rows.select(*panel.columns, F.when(F.col("_d") > 0, (F.col(label) - F.col("_a")) / F.col("_d")).alias("label_z"))


def equal_date_weights(panel: DataFrame, date: str) -> DataFrame:
    """``weight``: every date weighs the same, and the mean weight is 1."""
    n = panel.groupBy(date).agg(F.count("*").alias("_n"))
    total = n.agg(F.sum("_n").alias("_rows"), F.count("*").alias("_dates"))
    each = n.crossJoin(F.broadcast(total)).select(date, (F.col("_rows") / (F.col("_dates") * F.col("_n"))).alias("weight"))
    return panel.join(each, date)


def neutralize(panel: DataFrame, score: str, size: str = "size", industry: str = "industry", date: str = "trade_date", out: str = "neutral_score", fail: bool = False) -> DataFrame:
    """``out``: the residual of score on ln size and industry, per date; a null industry is one of its own.

    A size without a finite logarithm gives NULL, or with ``fail`` an error.  One shuffle by date serves both levels.
    """
    log = clean(F.ln(size))
    if fail and panel.where(log.isNull()).limit(1).count():
        raise ContractError(f"{size} has no finite logarithm")
    rows = panel.repartition(date).withColumn("_i", F.coalesce(industry, F.lit("Unknown"))).withColumn("_z", log)
    group, day = Window.partitionBy(date, "_i"), Window.partitionBy(date)
    rows = rows.withColumn("_ds", F.col(score) - F.avg(score).over(group)).withColumn("_dz", F.col("_z") - F.avg("_z").over(group))
    slope = sdiv(F.sum(F.col("_ds") * F.col("_dz")).over(day), F.sum(F.col("_dz") * F.col("_dz")).over(day))
    return rows.withColumn("_b", slope).select(*panel.columns, (F.col("_ds") - F.coalesce("_b", F.lit(0.0)) * F.col("_dz")).alias(out))


def rank_ic(panel: DataFrame, score: str, label: str, date: str, *by: str) -> DataFrame:
    """Spearman correlation per date (and group): average ranks, then Pearson; NULL below two distinct values."""
    known = F.col(score).isNotNull() & F.col(label).isNotNull()
    rows = panel.select(date, *by, score, label, known.alias("_ok")).repartition(date, *by)
    ranked = rows.select(date, *by, "_ok", avg_rank(score, date, *by, "_ok").alias("_x"), avg_rank(label, date, *by, "_ok").alias("_y"))
    x, y = (F.when(F.col("_ok"), F.col(c)) for c in ("_x", "_y"))
    return ranked.groupBy(date, *by).agg(F.count("*").alias("cross_section_rows"), scorr(x, y).alias("rank_ic"))


def evaluate_ic(panel: DataFrame, horizons: tuple[int, ...] = (1, 5, 20), date: str = "trade_date") -> DataFrame:
    """``pearson_ic, rank_ic, n_names`` per date, horizon and eligibility (``basic``, ``tradable``).

    Pairs are finite score and label; below 3 names or 2 distinct values of a side the ICs are NULL, and the row stays.
    A row is shuffled once and sorted once by its score and once by each label: ranks of all horizons and eligibilities are
    counts of their rows up to a value.
    """
    valid_horizons(horizons)
    basic = F.coalesce("basic_eligible", F.lit(False))
    kinds = {"basic": basic, "tradable": basic & F.coalesce("tradable_next_open", F.lit(False))}
    scored = clean(F.col("directed_score")).isNotNull()
    flags = {(e, h): f"_{e}_{h}" for h in horizons for e in kinds}
    usable = [(kinds[e] & scored & clean(F.col(f"label_excess_o2o_{h}d")).isNotNull()).alias(c) for (e, h), c in flags.items()]
    labels = {h: f"_label{h}" for h in horizons}
    rows = panel.select(date, "directed_score", *(F.col(f"label_excess_o2o_{h}d").alias(c) for h, c in labels.items()), *usable)
    rows = rows.select("*", *(avg_rank_of(c, "directed_score", date).alias(f"_x{c}") for c in flags.values()))
    for h, label in labels.items():
        rows = rows.select("*", *(avg_rank_of(c, label, date).alias(f"_y{c}") for (_, k), c in flags.items() if k == h))
    at = lambda c, x: F.when(F.col(c), F.col(x))
    each = F.explode(F.array(*(
        F.struct(F.lit(e).alias("eligibility"), F.lit(h).alias("horizon_days"), F.col(c).alias("ok"), at(c, "directed_score").alias("s"), at(c, labels[h]).alias("l"), at(c, f"_x{c}").alias("x"), at(c, f"_y{c}").alias("y"))
        for (e, h), c in flags.items()
    )))
    long = rows.select(date, each.alias("e")).select(date, "e.*")
    enough = (F.count_if("ok") >= 3) & (F.min("x") < F.max("x")) & (F.min("y") < F.max("y"))
    pearson, rank = (F.when(enough, scorr(F.col(a), F.col(b))) for a, b in (("s", "l"), ("x", "y")))
    return long.groupBy(date, "eligibility", "horizon_days").agg(pearson.alias("pearson_ic"), rank.alias("rank_ic"), F.count_if("ok").alias("n_names"))


def quintiles(panel: DataFrame, score: str, label: str, date: str, key: str = "security_id", q: int = 5, fail: bool = False) -> DataFrame:
    """Mean label and count per date and score bucket, plus the top-minus-bottom row (bucket ``q`` + 1).

    Buckets are quantile bins of first ranks: the bin of rank r of n is max(1, ceil((r - 1) q / (n - 1))).
    Dates with fewer than q names, or q distinct scores, give no rows; with ``fail`` they are an error, dates without any name among them.
    """
    ok = F.col(score).isNotNull() & F.col(label).isNotNull()
    if fail:
        counts = panel.groupBy(date).agg(F.count_if(ok).alias("names"), F.countDistinct(F.when(ok, F.col(score))).alias("scores"))
        if bad := counts.where(f"names < {q} or scores < {q}").limit(1).collect():
            raise ContractError(f"{bad[0][date]} has {bad[0].names} names and {bad[0].scores} scores for {q} buckets")
    known = panel.where(ok).select(date, score, label, key)
    day = Window.partitionBy(date)
    rows = known.select("*", F.dense_rank().over(day.orderBy(score)).alias("_k"), F.row_number().over(day.orderBy(score, key)).alias("_rn"))
    rows = rows.select("*", F.count("*").over(day).alias("_n"), F.max("_k").over(day).alias("_u")).where(f"_n >= {q} and _u >= {q}")
    bucket = F.greatest(F.lit(1), F.ceil((F.col("_rn") - 1) * q / (F.col("_n") - 1))).cast("int")
    means = rows.groupBy(date, bucket.alias("quintile")).agg(F.avg(label).alias("mean_return"), F.count("*").alias("n_names"))
    listed = means.groupBy(date).agg(F.collect_list(F.struct("quintile", "mean_return", "n_names")).alias("b"))
    top, bottom = F.get(F.filter("b", lambda x: x["quintile"] == q), 0), F.get(F.filter("b", lambda x: x["quintile"] == 1), 0)
    spread = F.struct(F.lit(q + 1).alias("quintile"), (top["mean_return"] - bottom["mean_return"]).alias("mean_return"), (top["n_names"] + bottom["n_names"]).alias("n_names"))
    return listed.select(date, F.explode(F.concat("b", F.array(spread))).alias("b")).select(date, "b.*")


def common_predictions(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str], label: str | None = None) -> DataFrame:
    """Full outer join of two models' tables with suffixes; ``complete`` marks rows that both have.

    With ``label``, both tables must have it and agree on it wherever both have the row.
    """
    taken = [*columns, label] if label else columns
    x = a.select(*keys, *(F.col(c).alias(f"{c}_a") for c in taken)).withColumn("_a", F.lit(True))
    y = b.select(*keys, *(F.col(c).alias(f"{c}_b") for c in taken)).withColumn("_b", F.lit(True))
    j = x.join(y, keys, "full").withColumn("complete", F.col("_a").isNotNull() & F.col("_b").isNotNull())
    if label and j.where(f"complete and not coalesce(abs({label}_a - {label}_b) <= 1e-12, {label}_a is null and {label}_b is null)").limit(1).count():
        raise ContractError(f"the tables disagree on {label}")
    return j.drop("_a", "_b")
