"""The corpus pipeline: five stages over ``documents``, each one of the numbered operators.

Every stage works on all rows that the one before it kept.  ``ORACLE_SQL`` is None, as the
stages of language, secrets and near-duplicates have no SQL form; ``tests/llm`` hold the pipeline
against a brute-force version.  Repeated rows go the same way, save that mixing may take equal ones
together; columns beside those of ``documents`` pass through; an empty table stays empty in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm import language, mixing, secrets
from tidepanel.llm.near_dup import NearDup, near_duplicates
from tidepanel.llm.positional import contaminated, contamination
from tidepanel.llm.sieve import without
from tidepanel.llm.store import written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a language (null, or no letters) go; the others carry the predicted ``lang``.

    A null id or source makes no difference; ties go to the smaller code.
    """
    model = language.fit(docs.where(~language.held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    found = language.predict(docs, model).where("lang_pred <> 'und'")
    return found.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, 0.8) the smallest id stays; null texts, texts without words and null ids stay."""
    found = near_duplicates(docs, NearDup(shingle=5, percent=80, bands=28))
    return without(docs, found.groupBy("doc_id").agg(F.bool_or("kept").alias("kept")).where("not kept"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that the benchmark contaminates go; null texts, empty texts and null ids stay."""
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without(docs, found.where(contaminated(F.col("n_hit"), F.col("n_words"))))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret span becomes a mark, overlapping ones share one; all texts stay, a null text as null."""
    found = secrets.scan(docs, secrets.fit(docs))
    text = secrets.redacted(F.col("text"), F.col("secret_spans"))
    return found.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: the documents that it takes, with their texts, how often each goes in (``copies``), and the words that makes."""
    return mixing.mix_rows(docs).where("copies > 0")


STAGES = [
    ("language ID", identify_language),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secret scan", redact_secrets),
    ("mixing", mix_sources),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``; each but the last is written as Parquet in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
