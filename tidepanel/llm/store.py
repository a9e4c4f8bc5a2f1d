"""Shared-folder tables that cut lineage and survive the loss of executors; batches of bounded size for Python workers."""

from pyspark.sql import SparkSession

from tidepanel.sources.sinks import discard, shared_dir, written

__all__ = ["discard", "prompt_cleanup", "shared_dir", "small_batches", "written"]

#: Bytes of rows that go to a Python worker at once.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to ``BATCH_BYTES``: rows are whole texts, and executor and worker hold a batch each."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now is None or not now.rstrip("b").isdigit() or int(now.rstrip("b")) > BATCH_BYTES:
        spark.conf.set(key, BATCH_BYTES)


def prompt_cleanup(spark: SparkSession) -> None:
    """Shuffle files of the session's queries go when a query ends, not when the driver next collects its garbage."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", True)
