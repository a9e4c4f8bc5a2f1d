"""Purged rolling-fold models: pooled weighted Ridge, parameter grids and the choice among tree candidates (grown in ``trees``)."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepanel.operators.contracts import ContractError

#: The Ridge penalties tried.
ALPHAS = (0.1, 1.0, 10.0, 100.0)


def _lists(batch: pa.RecordBatch, n: int) -> np.ndarray:
    """The arrays ``x`` of n numbers as a matrix."""
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, n)


def _listed(rows: DataFrame, features: list[str]) -> Column:
    """The features as one array ``x``, which rows may have already."""
    return F.col("x") if dict(rows.dtypes).get("x") == "array<double>" else F.array(*(F.col(f).cast("double") for f in features)).alias("x")


def _gram(n: int):
    """Weighted Gram matrix of each fold in a partition, a row of it per output row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            x = np.column_stack([np.ones(batch.num_rows), _lists(batch, n - 2), batch.column("y").to_numpy(zero_copy_only=False)])
            w, fold = batch.column("w").to_numpy(zero_copy_only=False), np.array(batch.column("fold").to_pylist(), object)
            known = np.ones(len(x), bool)
            known[np.flatnonzero(batch.column("x").flatten().is_null().to_numpy(zero_copy_only=False)) // (n - 2)] = False
            x, w, fold = x[known], w[known], fold[known]
            for f in set(fold.tolist()):
                own = fold == f
                sums[f] = sums.get(f, 0.0) + (x[own] * w[own, None]).T @ x[own]
        for f, g in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([f] * n, pa.string()), pa.array(range(n), pa.int32()), pa.array(list(g), pa.list_(pa.float64()))], names=["fold", "i", "g"])

    return run


def ridge(rows: DataFrame, features: list[str], label: str, weight: str, alphas: tuple[float, ...] = ALPHAS, by: str = "fold") -> DataFrame:
    """``by, alpha, feature, coefficient`` (with ``__intercept__``) of weighted Ridge, for all folds and alphas in one pass.

    Each partition makes the weighted Gram matrix of its rows, Spark adds those up row by row; one matrix of (features + 2)^2
    sums per fold comes to the driver, where each penalty is a small solve.  The intercept is not penalised.  Rows with
    a NULL in a feature, the label or the weight are left out; a fold whose weights sum to nothing is refused.  Rows with the features as
    an array ``x`` of doubles beside their columns are read by that.
    """
    n = len(features) + 2
    known = rows.select(F.col(by).cast("string").alias("fold"), F.col(weight).cast("double").alias("w"), F.col(label).cast("double").alias("y"), _listed(rows, features)).where("w is not null and y is not null")
    parts = known.mapInArrow(_gram(n), "fold string, i int, g array<double>").select("fold", "i", array_to_vector("g").alias("g"))
    grams: dict[str, np.ndarray] = {}
    for r in parts.groupBy("fold", "i").agg(Summarizer.sum(F.col("g")).alias("g")).collect():
        grams.setdefault(r["fold"], np.zeros((n, n)))[r["i"]] = r["g"].toArray()
    out = []
    for fold, g in sorted(grams.items()):
        if not g[0, 0] > 0:
            raise ContractError(f"the weights of {fold} sum to {g[0, 0]}")
        mean = g[0, 1:] / g[0, 0]
        centred = g[1:, 1:] - np.outer(mean, mean) * g[0, 0]
        for alpha in alphas:
            beta = np.linalg.solve(centred[:-1, :-1] + alpha * np.eye(n - 2), centred[:-1, -1])
            out.append((fold, alpha, "__intercept__", float(mean[-1] - mean[:-1] @ beta)))
            out += [(fold, alpha, f, float(b)) for f, b in zip(features, beta, strict=True)]
    made = rows.sparkSession.createDataFrame(out, "fold string, alpha double, feature string, coefficient double")
    return made.select(F.col("fold").cast(dict(rows.dtypes)[by]).alias(by), "alpha", "feature", "coefficient")


def predict_linear(rows: DataFrame, coefficients: DataFrame, features: list[str], by: str = "fold") -> DataFrame:
    """``rows``, less the features, once per alpha with ``score``; the coefficients, a row per fold, alpha and feature, are broadcast.

    Products are added in the order of the features, so equal rows have equal scores.  A row with a NULL in a feature has none.
    """
    told: dict = {}
    for r in coefficients.select(F.col(by).cast("string").alias("by"), "alpha", "feature", "coefficient").collect():
        told.setdefault(r["by"], {}).setdefault(r["alpha"], {})[r["feature"]] = r["coefficient"]
    shared = rows.sparkSession.sparkContext.broadcast({k: [(a, [c["__intercept__"], *(c[f] for f in features)]) for a, c in own.items()] for k, own in told.items()})
    kept = [c for c in rows.columns if c not in (*features, "x")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group = np.array([None if v is None else str(v) for v in batch.column("_by").to_pylist()], object)
            for k, own in shared.value.items():
                at = np.flatnonzero(group == k)
                if not len(at):
                    continue
                x, rest = np.ascontiguousarray(_lists(batch, len(features))[at].T), batch.select(kept).take(pa.array(at))
                for alpha, (score, *b) in own:
                    score = np.full(len(at), score)
                    for value, weight in zip(x, b, strict=True):
                        score += value * weight
                    yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(np.full(len(at), alpha)), pa.array(score, from_pandas=True)], names=[*kept, "alpha", "score"])

    schema = ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes if c in kept), "alpha double, score double"])
    return rows.select(*kept, F.col(by).cast("string").alias("_by"), _listed(rows, features)).mapInArrow(run, schema)


#: The parameter set that is carried over unchanged, as one candidate; losses are squared.
TRANSFER = {"feature_fraction": 0.8879, "learning_rate": 0.2, "bagging_fraction": 0.8789, "lambda_l1": 205.6999, "lambda_l2": 580.9768, "max_depth": 8, "num_leaves": 210, "seed": 42}


def best_tree_candidates(candidates: DataFrame, by: str = "fold") -> DataFrame:
    """Per fold the candidate of highest mean IC and ICIR; of equals the one with fewest leaves, then most rows a leaf,
    strongest penalty, largest step, smallest id.  Null statistics come last."""
    down = ("mean_rank_ic", "rank_icir")
    order = [F.desc_nulls_last(c) for c in down] + [F.asc("num_leaves"), F.desc("min_data_in_leaf"), F.desc("lambda_l2"), F.desc("learning_rate"), F.asc("candidate_id")]
    return candidates.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where("_r = 1").drop("_r")


def candidate_grid(spark: SparkSession, grid: dict[str, list]) -> DataFrame:
    """All combinations of a parameter grid, numbered in order as ``candidate_id``; its size is the product of the lists given."""
    rows = [(k, *values) for k, values in enumerate(itertools.product(*grid.values()))]
    return spark.createDataFrame(rows, ["candidate_id", *grid])
