"""Completeness of published runs, found from the files that are there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.operators.contracts import ID_PATTERN, ContractError

_PLACE = r"/factor_id=([^/]*)/run_id=([^/]*)/(?:attempt=([^/]*)/([^/]+)|(manifest))/[^/]+$"


def listing(spark: SparkSession, root: str) -> DataFrame:
    """``factor_id, run_id, attempt, artifact, length`` of every file below ``root``, from paths alone: no file is read.

    A manifest's file has neither attempt nor artifact; files elsewhere are left out.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    part = lambda k: F.when(F.regexp_extract("path", _PLACE, k) != "", F.regexp_extract("path", _PLACE, k))
    named = files.where(F.col("path").rlike(_PLACE))
    return named.select(part(1).alias("factor_id"), part(2).alias("run_id"), part(3).alias("attempt"), part(4).alias("artifact"), "length")


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """Every manifest with the identity of its path (``at_factor, at_run``) beside its own."""
    own = spark.read.schema("factor_id string, run_id string, attempt string, artifacts array<string>").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(root)
    at = lambda k: F.regexp_extract("_metadata.file_path", _PLACE, k)
    return own.select("*", at(1).alias("at_factor"), at(2).alias("at_run")).where("at_run <> ''")


def run_audit(spark: SparkSession, root: str, required: tuple[str, ...]) -> DataFrame:
    """A row per run under ``root/factor_id=/run_id=``: ``factor_id, run_id`` of the path, ``n_manifests``, what is wrong, ``complete``.

    ``missing`` are required artifacts without a file in the attempt that the manifest names, ``extra`` artifacts there that
    are not required; ``undeclared`` tells a declared list other than the required one, ``foreign`` an identity other than the path's,
    ``unsafe`` ids unfit for a path.  Attempts that no manifest names are not looked at.  A run without a manifest misses everything.
    """
    need = F.array(*map(F.lit, sorted(required)))
    none = F.array().cast("array<string>")
    files = listing(spark, root)
    told = manifests(spark, root)
    seen = files.select("factor_id", "run_id").distinct()
    keys = [F.col("at_factor").alias("factor_id"), F.col("at_run").alias("run_id")]
    have = files.where("artifact is not null").join(told.select(*keys, "attempt"), ["factor_id", "run_id", "attempt"], "left_semi")
    have = have.groupBy("factor_id", "run_id").agg(F.collect_set("artifact").alias("have"))
    same = (F.col("factor_id") == F.col("at_factor")) & (F.col("run_id") == F.col("at_run"))
    each = told.select(*keys, F.coalesce(~same, F.lit(True)).alias("foreign"), F.coalesce(F.array_sort("artifacts") != need, F.lit(True)).alias("undeclared"))
    each = each.groupBy("factor_id", "run_id").agg(F.count("*").alias("n_manifests"), F.bool_or("foreign").alias("foreign"), F.bool_or("undeclared").alias("undeclared"))
    rows = seen.join(each, ["factor_id", "run_id"], "left").join(have, ["factor_id", "run_id"], "left").fillna(0, ["n_manifests"]).fillna(True, ["foreign", "undeclared"])
    rows = rows.withColumn("have", F.coalesce("have", none)).withColumn("unsafe", ~(F.col("factor_id").rlike(ID_PATTERN) & F.col("run_id").rlike(ID_PATTERN)))
    rows = rows.withColumn("missing", F.array_sort(F.array_except(need, "have"))).withColumn("extra", F.array_sort(F.array_except("have", need)))
    good = (F.col("n_manifests") == 1) & ~F.col("foreign") & ~F.col("undeclared") & ~F.col("unsafe") & (F.size("missing") == 0) & (F.size("extra") == 0)
    return rows.select("factor_id", "run_id", "n_manifests", "missing", "extra", "undeclared", "foreign", "unsafe", good.alias("complete"))


def require_complete(spark: SparkSession, root: str, required: tuple[str, ...]) -> None:
    """Refuse a folder with an incomplete run."""
    bad = run_audit(spark, root, required).where("not complete").first()
    if bad:
        raise ContractError(f"run {bad.factor_id}/{bad.run_id} is not complete: {bad.asDict()}")
