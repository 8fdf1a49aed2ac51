"""The registered queries of this package and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import chat, hard_negatives, jaccard, manifest, packing, quality, secret_scan, sharding, substrings, templates, token_counts, url_filter, warc
from factloom.llm.oracles import ORACLES
from factloom.session import configure

URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secret_scan.findings(table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_random")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.round_trip(table(spark, sf_dir, "pages"))
    # A revisit has the digest alone. Both are of the full payload.
    return rows.select("page_id", "payload_bytes", F.coalesce("own_digest", "digest").alias("payload_digest"), "record_type", "refers_to")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    # A conversation whose texts hold the control strings of common templates.
    marked = F.explode(F.array(*[F.struct(F.lit(-7).alias("conv_id"), F.lit(i).alias("turn"), F.lit(r).alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text")) for i, r in enumerate(("user", "assistant"))]))
    rows = given.unionByName(spark.range(1).select(marked.alias("x")).select("x.*"))
    return chat.read_back(chat.conversations(rows, public_tokenizers.path("byte_bpe_50k.json")))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)
    return rows.withColumnRenamed("id", "page_id")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = token_counts.count(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return rows.withColumnRenamed("id", "doc_id")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return rows.select(
        F.col("id").alias("doc_id"), "start", "length", F.col("crc").alias("ids_crc32"), F.col("n_tokens").alias("doc_tokens"),
        F.col("sequence").alias("sequence_id"), F.col("place").alias("offset"),
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.judge(table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_left")


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = jaccard.join(table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = templates.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select(F.col("id").alias("doc_id"), "item_id", "n_words", "n_covered", "n_slots", "n_changed")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = hard_negatives.mine(given.select("vec_id", "embedding", label.alias("label")), "vec_id", "embedding", "label", F.col("vec_id") % 100 == 0)
    return rows.select(
        F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("negative").alias("negative_id"),
        "positive_score", "negative_score",
    )


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard(table(spark, sf_dir, "documents"), shards=16)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    rows = manifest.verify(table(spark, sf_dir, "documents"), chosen, manifest.lower_ascii(F.col("text")))
    return rows.withColumnRenamed("proof", "proof_sha256")


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_warc, op3_chat_format, op4_url_filter, op5_token_counts, op6_packing, op7_quality_rules, op8_ngram_jaccard, op9_substring_dedup, op10_decontamination, op11_hard_negatives, op12_sharding, op13_merkle_manifest)}
__all__ = ["ORACLES", "QUERIES"]
