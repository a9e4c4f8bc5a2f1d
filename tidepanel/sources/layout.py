"""The stored layout of a long panel: folders by year, buckets and order by security."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_panel(panel: DataFrame, table: str, buckets: int, date: str = "trade_date", security: str = "security_id", mode: str = "errorifexists") -> None:
    """Save as a catalog table, ``year=`` folders with ``buckets`` buckets by security, each in order of (security, date).

    Rows are dealt by security as the buckets are, so a task writes one file for each of its years.  A NULL date goes to the folder of no year.
    """
    rows = panel.withColumn("year", F.year(date)).repartition(buckets, security)
    rows.write.partitionBy("year").bucketBy(buckets, security).sortBy(security, date).mode(mode).format("parquet").saveAsTable(table)


def read_panel(spark: SparkSession, table: str, since: int | None = None, until: int | None = None) -> DataFrame:
    """The panel of the years from ``since`` to ``until``: other folders are not opened.

    Windows and aggregates by security need no shuffle: buckets are its partitioning already.
    """
    rows = spark.table(table)
    if since is not None:
        rows = rows.where(F.col("year") >= since)
    if until is not None:
        rows = rows.where(F.col("year") <= until)
    return rows
