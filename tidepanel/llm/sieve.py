"""A bitmap of fixed size that tells which ids can be in a set, so that texts of others need no shuffle."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.store import written

_PAGE_LOG2 = 15


def sieve(ids: DataFrame, id_col: str, bits_log2: int = 26) -> Callable[[Column], Column]:
    """A test for ids, given as longs: never false for one that ``ids`` holds; true for few others while ``ids`` is small.

    What reaches the driver and the tasks is the bitmap, of 2 ** bits_log2 bits (8 MB) at most,
    whatever the number of ids.  A full bitmap lets all ids through: an exact join has to follow.
    Nulls are tested like any other value.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << bits_log2))
    at = ids.select(place(F.col(id_col).cast("long")).alias("at"))
    pages = at.groupBy(F.shiftright("at", _PAGE_LOG2).alias("page")).agg(F.bitmap_construct_agg(F.col("at").bitwiseAND((1 << _PAGE_LOG2) - 1)).alias("bits"))
    bitmap = np.zeros((1 << (bits_log2 - _PAGE_LOG2), 1 << (_PAGE_LOG2 - 3)), np.uint8)
    for row in pages.toLocalIterator():
        bitmap[row["page"]] = np.frombuffer(row["bits"], np.uint8)
    shared = ids.sparkSession.sparkContext.broadcast(bitmap.reshape(-1))

    @F.pandas_udf("boolean")
    def holds(where: pd.Series) -> pd.Series:
        i = where.to_numpy(np.int64)
        return pd.Series((shared.value[i >> 3] >> (i & 7)) & 1 == 1)

    return lambda c: holds(place(c.cast("long")))


def without(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id is not among ``ids``; only rows that can be among them are shuffled.

    Null ids and repeated rows stay; no ids, or no rows, are fine.
    """
    gone = written(ids.select(id_col).where(F.col(id_col).isNotNull()).distinct(), "gone")
    rows = docs.withColumn("__maybe", F.coalesce(sieve(gone, id_col)(F.col(id_col)), F.lit(True)))
    maybe = rows.where("__maybe").join(gone.hint("merge"), id_col, "left_anti")
    return rows.where("not __maybe").unionByName(maybe).select(*docs.columns)
