"""The corpus pipeline: toxicity, language identification, near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of documents.
``run`` writes each stage's result to the shared folder and gives the next stage the table read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logspark.llm import langid, ngram_join, packing, secret_scan, toxicity
from logspark.llm.shared import Scratch, collect_garbage

#: Rows of a batch between Spark and Python, at most: a task holds a few batches of texts on both sides.
BATCH_ROWS = 1000


def prepare(spark: SparkSession) -> None:
    """Executors give back what the stage before has grown, and batches have at most BATCH_ROWS rows in this session (a
    smaller setting stays)."""
    collect_garbage(spark)
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(setting)) <= BATCH_ROWS:
        spark.conf.set(setting, str(BATCH_ROWS))


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold."""
    prepare(spark)
    return toxicity.keep_civil(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not rejected."""
    prepare(spark)
    return langid.keep_identified(docs, langid.fit(docs))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of smallest id."""
    prepare(spark)
    return ngram_join.keep_one(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced."""
    prepare(spark)
    return secret_scan.redact(docs, secret_scan.train(secret_scan.example_findings(spark)), path_col="source" if "source" in docs.columns else None)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, placed in sequences of at most 1024 tokens."""
    prepare(spark)
    return packing.pack(docs)


STAGES = [("toxicity", civil), ("language ID", identified), ("n-gram Jaccard join", distinct_texts), ("secret scans", without_secrets), ("best-fit packing", packed)]

#: Models, similarity and packing are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
