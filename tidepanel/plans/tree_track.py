"""The boosted-tree track on the derived panel: candidates over purged folds, the choice on validation, test rows scored once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.operators import models, trees, wide
from tidepanel.operators.rolling import all_features, feature_names
from tidepanel.sources.sinks import discard, written

#: Rounds that a model takes at most, and goes on without a better validation rank IC, in the registered queries.
ROUNDS, PATIENCE = 2000, 100
#: One candidate for the queries that look at rounds.
SINGLE = {"num_leaves": 15, "learning_rate": 0.05, "min_data_in_leaf": 100, "lambda_l2": 1.0} | trees.SHARES

_FITTED: dict[tuple, trees.Fitted] = {}


def date_weights(rows: DataFrame) -> DataFrame:
    """``rows`` with ``w``: every train date of a fold weighs the same, their mean weight is 1; other roles have 1."""
    dates = rows.where("role = 'train'").groupBy("fold", "role", "signal_date").agg(F.count("*").alias("_n"))
    total = dates.groupBy("fold").agg(F.sum("_n").alias("_rows"), F.count("*").alias("_dates"))
    each = dates.join(total, "fold").select("fold", "role", "signal_date", (F.col("_rows") / (F.col("_dates") * F.col("_n"))).alias("w"))
    return rows.join(F.broadcast(each), ["fold", "role", "signal_date"], "left").withColumn("w", F.coalesce("w", F.lit(1.0)))


def fold_rows(panel: DataFrame, assigned: DataFrame) -> DataFrame:
    """``assigned(fold, role, signal_date, security_id, y, ...)`` with ``w`` and ``x``, the binned features: a byte each, binned before rows meet folds; stored."""
    names = feature_names()
    cuts = trees.normal_cuts(len(names))
    features = written(all_features(panel, packed=True), "features")
    x = wide.preprocess(features, names, "trade_date", lambda z: trees.bins_of(z, cuts)).withColumnRenamed("trade_date", "signal_date")
    rows = written(date_weights(assigned).join(x, ["signal_date", "security_id"]), "fold-rows")
    discard(features)
    return rows


def _stamp(s: SparkSession, d: str) -> tuple:
    """The session, and the files of the panel's source with their times."""
    files = s.read.parquet(f"{d}/lineitem.parquet").select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct().collect()
    return (s.sparkContext.applicationId, *sorted(map(tuple, files)))


def fitted(s: SparkSession, d: str, rows: DataFrame, candidates: list[dict]) -> trees.Fitted:
    """Trees of the candidates for every fold; a session fits the same candidates on the same files once."""
    key = (_stamp(s, d), repr(candidates), ROUNDS, PATIENCE)
    if key not in _FITTED:
        names = feature_names()
        _FITTED[key] = trees.fit(rows, names, candidates, trees.normal_cuts(len(names)), ROUNDS, PATIENCE)
    return _FITTED[key]


def grid(s: SparkSession) -> tuple[DataFrame, list[dict]]:
    table = models.candidate_grid(s, trees.GRID)
    return table, [{k: r[k] for k in trees.GRID} | trees.SHARES for r in table.orderBy("candidate_id").collect()]


def candidates(s: SparkSession, d: str, rows: DataFrame) -> DataFrame:
    """Per fold and candidate its parameters, best round, validation statistics, and whether it is the fold's choice."""
    table, made = grid(s)
    found = trees.best_rounds(fitted(s, d, rows, made).rounds).join(F.broadcast(table), "candidate_id")
    choice = models.best_tree_candidates(found).select("fold", "candidate_id", F.lit(True).alias("chosen"))
    return found.join(choice, ["fold", "candidate_id"], "left").withColumn("chosen", F.coalesce("chosen", F.lit(False)))


def chosen_trees(s: SparkSession, d: str, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The chosen candidates, and their nodes up to their best round."""
    picked = candidates(s, d, rows).where("chosen")
    return picked, trees.upto(fitted(s, d, rows, grid(s)[1]).trees, picked)


def scored(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    names = feature_names()
    return trees.predict(rows.where("role = 'test'"), nodes, names, trees.normal_cuts(len(names)))

