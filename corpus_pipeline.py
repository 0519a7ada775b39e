"""Documents to a training mix: quality, near duplicates, benchmark leaks, personal data, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet to the
shared folder and read again as the next one's documents. All but the last keep the columns of
``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from vintager.llm import decontaminate, mixing, pii, quality, sketch_join
from vintager.llm.common import table
from vintager.session import ensure_checkpoint_dir

# Near duplicates on word shingles: five words, a similarity of 0.8.
SHINGLE, PERCENT = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality policy keeps."""
    columns = docs.columns
    renamed = [f"__in{i}" for i in range(len(columns))]
    text = renamed[columns.index("text")]
    rows = quality.ledger(docs.toDF(*renamed), text)
    kept = rows.filter(quality.passes(quality.PRODUCTION))
    return kept.select(*renamed).toDF(*columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of smallest id."""
    return sketch_join.representatives(docs, SHINGLE, PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return pii.redacted(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often each document is taken, and how many words that makes."""
    return mixing.mix_sources(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("mixture", mixture),
]

# Near duplicates, edit distances and sampling have no counterpart in SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    ensure_checkpoint_dir(spark)
    shared = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    folder = f"{shared}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    return docs
