"""Operator 4: URL filters by temporal list join.

List entries are dated: an entry of a domain holds from its date until the next entry of the same list and
domain.  Each capture is evaluated against the entries active when it was fetched, for its host and every parent domain.
Captures are first folded to distinct (host, fetch time), and both sides are dealt by domain and stretch of
time, so neither a host with most of the captures nor a domain with a long history gathers in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STRETCH = 64


def host_of(url: Column) -> Column:
    """The lower-case host of a URL, without user, port or final dot; empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*?)\.?(?::[0-9]*)?(?:[/?#]|$)", 1), F.lit("")))


def parents(host: Column) -> Column:
    """The host and its parent domains, each with its number of labels."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def intervals(entries: DataFrame) -> DataFrame:
    """``list, domain, action, day`` to validity intervals ``[since, until)``; of entries of one day the last action by name holds.

    Rows with a null field are ignored; repeated rows count once.
    """
    once = entries.dropna(subset=["list", "domain", "action", "day"]).groupBy("list", "domain", "day").agg(F.max("action").alias("action"))
    following = F.lead("day").over(Window.partitionBy("list", "domain").orderBy("day"))
    return once.select("list", "domain", "action", F.col("day").alias("since"), following.alias("until"))


def url_filter(captures: DataFrame, entries: DataFrame, url_col: str = "url", day_col: str = "day") -> DataFrame:
    """``captures`` with ``host, n_active, verdict, matched``.

    Of the entries active on the day of the capture, the most specific domain decides; between lists
    ``block`` goes before others.  ``n_active`` counts active entries, ``matched`` names list and domain.
    Without an active entry (or host, or day) the verdict is ``allow``.  Captures keep their number;
    columns of the added names are replaced; empty tables give no verdicts or no rows.
    """
    captures = captures.drop("host", "n_active", "verdict", "matched").withColumn("host", host_of(F.col(url_col)))
    asked = captures.where(F.col(day_col).isNotNull() & (F.col("host") != "")).groupBy("host", F.col(day_col).alias("at")).agg(F.lit(1).alias("one"))
    stretch = lambda day: F.floor(F.datediff(day, F.lit("1970-01-01").cast("date")) / STRETCH)
    wide = asked.select("host", "at", F.explode(parents(F.col("host"))).alias("domain")).withColumn("part", stretch(F.col("at")))
    ends = asked.agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    held = intervals(entries).crossJoin(F.broadcast(ends)).where("since <= hi and (until is null or until > lo)")
    first, last = stretch(F.greatest("since", "lo")), stretch(F.least(F.coalesce(F.date_sub("until", 1), F.col("hi")), F.col("hi")))
    held = held.select("list", "domain", "action", "since", "until", F.explode(F.sequence(first, last)).alias("part"))
    active = wide.join(held, ["domain", "part"]).where("since <= at and (until is null or at < until)")
    rank = F.struct(F.length("domain").alias("specific"), (F.col("action") == "block").alias("block"), F.col("action").alias("verdict"), F.concat_ws(":", "list", "domain").alias("matched"))
    verdicts = active.groupBy("host", "at").agg(F.count("*").alias("n_active"), F.max(rank).alias("best"))
    out = captures.join(verdicts.withColumnRenamed("at", day_col), ["host", day_col], "left")
    kept = [c for c in captures.columns if c != "host"]
    return out.select(*kept, "host", F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict"), F.coalesce("best.matched", F.lit("")).alias("matched"))
