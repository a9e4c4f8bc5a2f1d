"""Append-only ingestion of panel rows: checks per micro-batch, rows of known keys dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tidepanel.operators.contracts import not_positive, require_columns
from tidepanel.sources.panel import DAILY

KEYS = ["trade_date", "security_id"]


def daily_stream(spark: SparkSession, path: str, schema: StructType = DAILY) -> DataFrame:
    """Rows of Parquet files as they arrive; ``schema`` may add columns to those of ``DAILY``."""
    return spark.readStream.schema(schema).parquet(path)


def append_daily(stream: DataFrame, path: str, checkpoint: str, event_time: str | None = None, late: str = "30 days") -> StreamingQuery:
    """Append each (date, security) once; a micro-batch with a price that is not positive fails.

    With ``event_time``, keys are remembered for ``late`` after it and then forgotten, so the state is bounded; without,
    every key is remembered.  Each micro-batch is a partition ``batch_id=`` of its own, which a retry overwrites.
    """

    def append(batch: DataFrame, number: int) -> None:
        require_columns(batch, DAILY.names)
        not_positive(batch, ["adjusted_open", "adjusted_close"], fail=True)
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={number}")

    once = stream.withWatermark(event_time, late).dropDuplicatesWithinWatermark(KEYS) if event_time else stream.dropDuplicates(KEYS)
    return once.writeStream.option("checkpointLocation", checkpoint).foreachBatch(append).trigger(availableNow=True).start()
