"""Long panels of (date, security): scans, the panel derived from ``lineitem``, and its companions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.functions.core import sdiv, series

DAILY = T.StructType([T.StructField("trade_date", T.DateType()), T.StructField("security_id", T.StringType()), T.StructField("adjusted_open", T.DoubleType()), T.StructField("adjusted_close", T.DoubleType())])


def scan(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet table (or a root of ``year=`` partitions, which then prune)."""
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def scan_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema, mode="FAILFAST")


def scan_summaries(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Run-summary JSON objects, one file per run, with the file they came from."""
    return spark.read.json(path, multiLine=True, schema=schema).withColumn("file", F.input_file_name())


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of every file under a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def fingerprint(df: DataFrame) -> DataFrame:
    """One row ``n, fingerprint``: rows, and the sum of their 64-bit hashes, which no order or partitioning changes.

    Unlike a digest of files it is one distributed scan, whatever their size.
    """
    columns = [F.col(f"`{c}`") for c in sorted(df.columns)]
    row = F.xxhash64(*columns, *(c.isNull() for c in columns)).cast("decimal(20,0)")
    return df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(row), F.lit(0)).cast("string").alias("fingerprint"))


def derived_panel(lines: DataFrame) -> DataFrame:
    """Monthly panel per supplier from ``lineitem``: one shuffle, partial aggregates.

    First and last prices of a month come from the least and the largest line by the line order.  Such structs cannot be
    aggregated by hash, so each task sorts its lines: by the supplier first, as the key of more values settles most
    comparisons without a look at the rows.
    """
    columns = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity"]
    order = F.struct(*columns)
    unit = lambda o="": F.col(f"{o}l_extendedprice") / F.col(f"{o}l_quantity")
    rows = lines.select(F.trunc("l_shipdate", "month").alias("trade_date"), F.col("l_suppkey").alias("security_id"), *columns, (F.col("l_returnflag") == "R").alias("_r"))
    made = rows.groupBy("security_id", "trade_date").agg(
        F.min(order).alias("_first"),
        F.max(order).alias("_last"),
        F.max(unit()).alias("adjusted_high"),
        F.min(unit()).alias("adjusted_low"),
        F.sum("l_quantity").alias("volume"),
        F.sum("l_extendedprice").alias("traded_amount"),
        F.count("*").cast("double").alias("turnover"),
        F.count_if("_r").alias("_n_r"),
    )
    return made.select(
        "trade_date", "security_id", unit("_first.").alias("adjusted_open"), "adjusted_high", "adjusted_low", unit("_last.").alias("adjusted_close"), (F.col("traded_amount") / F.col("volume")).alias("vwap"),
        "volume", "traded_amount", "turnover", (F.col("volume") >= 60).alias("is_member"), (F.col("_n_r") <= 3).alias("tradable_next_open"),
    )


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived_panel(scan(spark, f"{sf_dir}/lineitem.parquet"))


def benchmark(p: DataFrame) -> DataFrame:
    """One series: a row per session, so thousands at most."""
    return p.groupBy("trade_date").agg(F.avg("adjusted_open").alias("adjusted_open"), F.avg("adjusted_close").alias("adjusted_close"))


def with_market_return(p: DataFrame, bench: DataFrame) -> DataFrame:
    calendar = Window.orderBy("trade_date")
    market = bench.select("trade_date", (sdiv(F.col("adjusted_close"), F.lag("adjusted_close").over(calendar)) - 1).alias("market_return"))
    return p.join(F.broadcast(market), "trade_date", "left")


def with_size_and_industry(p: DataFrame, supplier: DataFrame, nation: DataFrame) -> DataFrame:
    total = F.sum("traded_amount").over(series().rowsBetween(Window.unboundedPreceding, 0))
    place = supplier.join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("security_id"), F.col("n_regionkey").cast("string").alias("industry"))
    return p.withColumn("size", total).join(place, "security_id", "left")


def membership(p: DataFrame, flag: bool = True) -> DataFrame:
    """Membership keys, optionally by flag."""
    return (p.where("is_member") if flag else p).select("trade_date", "security_id")


def tradability(p: DataFrame) -> DataFrame:
    return p.select("trade_date", "security_id", "tradable_next_open")
