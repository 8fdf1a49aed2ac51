"""The corpus pipeline: stages from documents to packed sequences, each written and read again before the next.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of documents:
quality drops rejected documents and takes boilerplate lines out, near copies leave one document of each group,
decontamination drops documents that leak a benchmark item, the secret scan replaces secrets by a mark. Packing returns a
row per piece of a sequence.

Defined cases: a null or blank text has no words, so the quality rules reject it; of rows equal in id and text one stays, as
of any near copies; null ids, sources, languages and lengths stay null; further columns are carried to packing, which reads id
and text alone; an empty table gives no piece.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import jaccard, packing, quality, secret_scan, templates
from factloom.session import configure, scratch_path, temporary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.clean(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return templates.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return rows.select(
        F.col("id").alias("doc_id"), "start", "length", F.col("crc").alias("ids_crc32"), F.col("n_tokens").alias("doc_tokens"),
        F.col("sequence").alias("sequence_id"), F.col("place").alias("offset"),
    )


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", decontamination),
    ("secret scans", secrets),
    ("packing", packed),
]

#: SQL can't cut texts into the tokenizer's ids; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of a folder. A stage's intermediate tables go once its result is written."""
    configure(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name.replace(' ', '-')}")
        with temporary(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
