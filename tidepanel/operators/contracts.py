"""Contracts over whole tables.  Each costs one aggregate; checks of one table share it."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A table breaks its contract."""


def require_columns(df: DataFrame, names: list[str], exact: bool = False) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    extra = [c for c in df.columns if c not in names] if exact else []
    if missing or extra:
        raise ContractError(f"missing columns {missing}, unexpected {extra}")
    return df


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    if duplicate_keys(df, keys).limit(1).count():
        raise ContractError(f"duplicate keys {keys}")
    return df


def bad_number(c: str) -> Column:
    """Not a finite number."""
    x = F.col(c).cast("double")
    return F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(True)) | x.isNull()


def not_positive(df: DataFrame, names: list[str], fail: bool = False) -> DataFrame:
    """``column, violations``: values that are not finite and above zero."""
    counts = df.agg(*(F.count_if(bad_number(c) | ~(F.col(c) > 0)).alias(c) for c in names))
    out = counts.unpivot([], names, "column", "violations")
    return _judge(out, fail)


def not_finite(df: DataFrame, names: list[str], fail: bool = False) -> DataFrame:
    """``column, violations``: values that are null, NaN or infinite."""
    return _judge(df.agg(*(F.count_if(bad_number(c)).alias(c) for c in names)).unpivot([], names, "column", "violations"), fail)


def _judge(out: DataFrame, fail: bool) -> DataFrame:
    if fail and (bad := out.where("violations > 0").collect()):
        raise ContractError(f"violations: {[tuple(r) for r in bad]}")
    return out


def unparsable_dates(df: DataFrame, name: str) -> DataFrame:
    """One row: how many values are not dates."""
    return df.agg(F.count_if(F.try_to_timestamp(F.col(name).cast("string")).isNull()).alias("violations"))


def all_true(df: DataFrame, flag: str) -> bool:
    return bool(df.agg(F.coalesce(F.bool_and(F.coalesce(F.col(flag), F.lit(False))), F.lit(True))).first()[0])


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join that must keep every row of both sides once; a NULL in a key meets nothing and is refused.

    One pass counts both sides' rows by key.
    """
    count = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    both = count(left, "_l").join(count(right, "_r"), keys, "full")
    if bad := both.where("coalesce(_l, 0) <> 1 or coalesce(_r, 0) <> 1").limit(1).collect():
        raise ContractError(f"the join is not one to one: {bad[0]}")
    return left.join(right, keys)


def label_gap(a: DataFrame, b: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Largest absolute difference of a label between two tables, and rows only one of them has."""
    x, y = a.select(*keys, F.col(label).alias("x")), b.select(*keys, F.col(label).alias("y"))
    return x.join(y, keys, "full").agg(F.max(F.abs(F.col("x") - F.col("y"))).alias("gap"), F.count_if(F.col("x").isNull() != F.col("y").isNull()).alias("one_sided"))


def purge_gaps(rows: DataFrame) -> DataFrame:
    """Per fold: last label end of each role against the first signal date of the next."""
    at = lambda role, f, c: f(F.when(F.col("role") == role, F.col(c)))
    g = rows.groupBy("fold").agg(at("train", F.max, "label_end_date").alias("train_end"), at("validation", F.min, "signal_date").alias("validation_start"), at("validation", F.max, "label_end_date").alias("validation_end"), at("test", F.min, "signal_date").alias("test_start"))
    return g.select("*", ((F.col("train_end") < F.col("validation_start")) & (F.col("validation_end") < F.col("test_start"))).alias("purged"))


def fold_coverage(rows: DataFrame, expected: DataFrame) -> DataFrame:
    """Per fold of ``expected(fold, year)``: years and dates of its test rows, whether they are of that year alone, and rows whose key is tested elsewhere too."""
    test = rows.where("role = 'test'").select("fold", "signal_date", "security_id")
    shared = test.groupBy("signal_date", "security_id").agg(F.count("*").alias("_n"))
    seen = test.join(shared, ["signal_date", "security_id"]).withColumn("_y", F.year("signal_date"))
    out = expected.join(seen, "fold", "left").groupBy("fold", "year")
    return out.agg(F.countDistinct("_y").alias("years"), F.countDistinct("signal_date").alias("dates"), F.coalesce(F.bool_and(F.col("_y") == F.col("year")), F.lit(False)).alias("expected"), F.count_if(F.col("_n") > 1).alias("shared_keys"))


def require_coverage(rows: DataFrame, expected: DataFrame, dates: int | None = None) -> None:
    """Refuse test rows of other years, folds without any, keys that two folds test, and, with ``dates``, folds of another number of dates."""
    wrong = ~F.col("expected") | (F.col("shared_keys") > 0)
    if dates is not None:
        wrong = wrong | (F.col("dates") != dates)
    if bad := fold_coverage(rows, expected).where(wrong).limit(1).collect():
        raise ContractError(f"test rows of a fold are not as expected: {bad[0]}")


def exactly_dates(series: DataFrame, by: list[str], n: int, date: str = "signal_date") -> DataFrame:
    """Series that do not have exactly n dates, one row each."""
    found = series.groupBy(*by).agg(F.count("*").alias("rows"), F.countDistinct(date).alias("dates"))
    return found.where((F.col("rows") != n) | (F.col("dates") != n))


def chronological(folds: DataFrame) -> DataFrame:
    """Fold specs ``fold, train array<int>, validation int, test int``: five train years before validation before test."""
    ok = (F.size("train") == 5) & (F.array_max("train") < F.col("validation")) & (F.col("validation") < F.col("test"))
    return folds.select("fold", ok.alias("chronological"))


def exactly_one(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that do not have exactly one row."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n <> 1")


def strict_cells(df: DataFrame, booleans: list[str] = (), numbers: list[str] = (), choices: dict[str, list[str]] | None = None) -> DataFrame:
    """``column, violations``: text cells that are not booleans, numbers or one of the choices."""
    checks: dict[str, Column] = {c: ~F.coalesce(F.lower(F.col(c)).isin("true", "false"), F.lit(False)) for c in booleans}
    checks |= {c: F.expr(f"try_cast({c} AS double)").isNull() for c in numbers}
    checks |= {c: ~F.coalesce(F.col(c).isin(v), F.lit(False)) for c, v in (choices or {}).items()}
    return df.agg(*(F.count_if(x).alias(c) for c, x in checks.items())).unpivot([], list(checks), "column", "violations")


def same_turnover(summary: DataFrame) -> DataFrame:
    """Portfolios whose gross and net rows disagree on mean turnover."""
    at = lambda kind: F.max(F.when(F.col("return_type") == kind, F.col("mean_turnover")))
    return summary.groupBy("horizon_days", "portfolio").agg(at("gross").alias("gross"), at("net").alias("net")).where("abs(gross - net) > 1e-12")


def artifacts_complete(manifest: DataFrame, required: list[str], found: DataFrame) -> DataFrame:
    """Runs whose declared artifacts differ from the required list or are not all in ``found(run_id, artifact)``."""
    have = found.groupBy("run_id").agg(F.collect_set("artifact").alias("have"))
    need = F.array(*map(F.lit, sorted(required)))
    bad = (F.array_sort("artifacts") != need) | (F.size(F.array_except(need, F.coalesce("have", F.array().cast("array<string>")))) > 0)
    return manifest.join(have, "run_id", "left").where(bad).select("run_id")


def valid_horizons(horizons: tuple[int, ...]) -> None:
    """Horizons are distinct positive whole numbers, one at least."""
    if not horizons or len(set(horizons)) != len(horizons) or any(not isinstance(h, int) or isinstance(h, bool) or h < 1 for h in horizons):
        raise ContractError(f"horizons must be distinct positive numbers: {horizons}")


def valid_portfolio(h: int, top_k: int, q: int, bps: float) -> None:
    """Holding period and top k are positive, there are two quantiles at least, costs are finite and not negative."""
    valid_horizons((h,))
    if not isinstance(top_k, int) or top_k < 1 or not isinstance(q, int) or q < 2:
        raise ContractError(f"top_k must be positive and q at least 2: {top_k}, {q}")
    if not (math.isfinite(bps) and bps >= 0):
        raise ContractError(f"costs must be finite and not negative: {bps}")


#: Fixed value: the form of run and factor ids.
ID_PATTERN = r"^[A-Za-z0-9][A-Za-z0-9_-]*$"


def unsafe_ids(df: DataFrame, column: str) -> DataFrame:
    """Rows whose id is null or unfit for a path: anything but letters, digits, underscores and hyphens."""
    return df.where(~F.coalesce(F.col(column).rlike(ID_PATTERN), F.lit(False)))


def portfolio_panel(panel: DataFrame, numbers: list[str], dates: list[str], keys: tuple[str, str] = ("trade_date", "security_id")) -> DataFrame:
    """The panel with numbers and dates cast, infinities null; null ids, unreadable dates and duplicate keys are refused.

    Numbers that cannot be read become NULL.  One aggregate serves the checks of nulls, another the keys.
    """
    require_columns(panel, [*keys, *numbers, *dates])
    cast = {c: F.expr(f"try_cast(`{c}` AS double)") for c in numbers}
    cast = {c: F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x) for c, x in cast.items()}
    cast |= {c: F.expr(f"try_cast(`{c}` AS date)") for c in (keys[0], *dates)}
    unread = [F.count_if(F.col(c).isNotNull() & cast[c].isNull()).alias(c) for c in (keys[0], *dates)]
    nulls = [F.count_if(F.col(k).isNull()).alias(f"null {k}") for k in keys]
    bad = {k: n for k, n in panel.agg(*unread, *nulls).first().asDict().items() if n}
    if bad:
        raise ContractError(f"unreadable dates or null keys: {bad}")
    return require_unique(panel.withColumns(cast), list(keys))


def violations(checks: dict[str, Column], df: DataFrame) -> DataFrame:
    """``contract, violations`` of many row predicates, in one scan."""
    none = F.lit(False)
    return df.agg(*(F.count_if(~F.coalesce(x, none)).alias(c) for c, x in checks.items())).unpivot([], list(checks), "contract", "violations")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
