"""Operator 10: mixing sources to target weights, by capped water-filling.

Every source has a weight and a cap (``epochs`` times its words).  Raising one level
gives each source level * weight words until it meets its cap; the level at which all
targets sum to the budget is where repeated resharing of the excess by weight ends.  With
sources ordered by cap / weight it follows from two running sums over the source table.

Each document is then taken a whole number of times: the whole part of target / words,
and once more for the documents whose running share of words, in a seeded order, lies below the
fractional part.  Running sums are taken over hash ranges of a source first and inside each
range after that, so no source is gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.llm.store import written

#: Weights by source in code point order, repeating.
WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    """Runs of non-space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, epochs: float = 2.0) -> DataFrame:
    """``source, size`` (a row per source) to ``source, source_size, target``.

    Sources are ordered by code point, null last.  The single-partition windows here see the
    source table alone: a name and a few numbers a source, whatever the number of documents.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    place = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1
    w = sizes.select("source", F.col("size").alias("source_size"), F.element_at(F.array(*map(F.lit, weights)), place.cast("int")).cast("double").alias("w"))
    w = w.withColumn("cap", F.col("source_size") * F.lit(float(epochs)))
    before = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source").cast("binary")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    budget = F.lit(float(share)) * F.sum("source_size").over(everything)
    left = budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    open_weight = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    levels = w.select("*", (left / open_weight).alias("level"))
    free = F.when(F.col("level") <= F.col("cap") / F.col("w"), F.col("level"))
    level = F.max(free).over(everything)
    return levels.select("source", "source_size", F.least(F.col("cap"), F.coalesce(level * F.col("w"), F.col("cap"))).alias("target"))


def _placed(docs: DataFrame, weights, share, epochs, seed, id_col, text_col, source_col, digits) -> DataFrame:
    """Rows with their source's target, whole repetitions, words for one more, and running words in the seeded order."""
    rows = docs.select(F.col(id_col).alias("doc_id"), word_count(F.col(text_col)).alias("size"), F.col(source_col).alias("source"))
    rows = rows.withColumn("u", _draw(F.col("doc_id"), seed))
    rows = written(rows.withColumn("range", F.substring("u", 1, digits)), "sizes")
    ranges = rows.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    goal = targets(ranges.groupBy("source").agg(F.sum("range_size").alias("size")), weights, share, epochs)
    placed = ranges.alias("r").join(goal.alias("g"), F.col("r.source").eqNullSafe(F.col("g.source"))).select("r.source", "range", "range_size", "source_size", "target")
    rep = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.select(
        "source",
        "range",
        "source_size",
        "target",
        F.floor(rep).alias("whole"),
        ((rep - F.floor(rep)) * F.col("source_size")).alias("extra"),
        F.coalesce(F.sum("range_size").over(earlier), F.lit(0)).alias("before"),
    )
    same = F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.range") == F.col("p.range"))
    both = rows.alias("d").join(placed.alias("p"), same).select("d.*", "source_size", "target", "whole", "extra", "before")
    running = Window.partitionBy("source", "range").orderBy("u", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    middle = F.col("before") + F.sum("size").over(running) - F.col("size") / 2
    return both.withColumn("once_more", (middle <= F.col("extra")) & (F.col("extra") > 0))


def _draw(doc_id: Column, seed: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), doc_id.cast("string")))


def mix_rows(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, epochs: float = 2.0, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", digits: int = 3) -> DataFrame:
    """``docs``, all columns, with ``size, source_size, target, copies, taken``, as ``mix`` tells them.

    Along the seeded order the rows taken once more come first, so each source has one last such row: a small
    table that is joined to the texts, which need no shuffle.  Rows equal in id and size are taken together.
    Columns of the added names are replaced.
    """
    placed = _placed(docs, weights, share, epochs, seed, id_col, text_col, source_col, digits)
    key = F.struct("u", "doc_id", "size")
    cut = placed.groupBy("source").agg(*(F.first(c).alias(c) for c in ("source_size", "target", "whole")), F.max(F.when(F.col("once_more"), key)).alias("_last"))
    cut = written(cut.withColumnRenamed("source", "_source"), "cuts")
    kept = docs.drop("size", "source_size", "target", "copies", "taken")
    own = F.struct(_draw(F.col(id_col), seed).alias("u"), F.col(id_col).alias("doc_id"), F.col("size"))
    both = kept.withColumn("size", word_count(F.col(text_col))).join(F.broadcast(cut), F.col(source_col).eqNullSafe(F.col("_source")), "left")
    copies = F.col("whole") + F.coalesce(own <= F.col("_last"), F.lit(False)).cast("long")
    return both.withColumn("copies", copies).withColumn("taken", copies * F.col("size")).select(*kept.columns, "size", "source_size", "target", "copies", "taken")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, epochs: float = 2.0, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", digits: int = 3) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, size, source, source_size, target, copies, taken``.

    ``taken`` = ``copies`` * ``size``, at most ceil(epochs) * size.  A source's taken words differ from its
    target by at most half of one document.  A null text has size 0; a null source is a source of its own,
    the last; null ids and repeated rows are rows like any other, and equal ones may be
    taken differently.  Extra columns are ignored; an empty table gives an empty one.
    """
    placed = _placed(docs, weights, share, epochs, seed, id_col, text_col, source_col, digits)
    out = placed.withColumn("copies", F.col("whole") + F.col("once_more").cast("long"))
    return out.select("doc_id", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix' || ':' || doc_id) AS u FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1] AS DOUBLE) AS w FROM s),
c AS (SELECT *, source_size * 2.0::DOUBLE AS cap FROM w),
l AS (SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM c)
       - coalesce(sum(cap) OVER (ORDER BY cap / w, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
     / ((SELECT sum(w) FROM c) - coalesce(sum(w) OVER (ORDER BY cap / w, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM c),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT max(level) FROM l WHERE level <= cap / w) * w, cap)) AS target FROM l),
r AS (SELECT d.*, source_size, target, CASE WHEN source_size = 0 THEN 0 ELSE target / source_size END AS rep,
        sum(size) OVER (PARTITION BY d.source ORDER BY u, doc_id, size ROWS UNBOUNDED PRECEDING) - size / 2 AS middle
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rep) + CASE WHEN middle <= (rep - floor(rep)) * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""
