"""The registered queries of the training-data operators.

Each applies its operator to its whole table and derives the columns of its
result from the operator's output.  ``QUERIES`` maps names to functions of
(spark, sf_dir), ``ORACLE`` to DuckDB SQL where SQL can express the result.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm import decontaminate, lm_mixing, mixing, oracles, packing, quality_mil, quality_rules, role_repair, secrets, simhash, token_counts, toxicity, vector_dedup, whitening
from riskframe.llm.base import read_table, shared_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {"op1_mix_sources": oracles.MIX_SOURCES, "op3_secret_scan": oracles.SECRET_SCAN,
                          "op12_decontaminate": oracles.DECONTAMINATE}


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


@register
def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target weights: shares of the source sizes, tempered by a square root."""
    return mixing.mix_sources(read_table(spark, sf_dir, "documents"), temper=0.5, epochs=1.0, seed=1)


@register
def op2_lm_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_mixing.lm_score(read_table(spark, sf_dir, "documents"), folds=10)


@register
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan_secrets(docs, shared_path(spark, "secret-ledger")).drop("text", "blob")
    spans = secrets.span_strings(F.col("findings"))
    n = [secrets.count_kind(F.col("findings"), r.kind).alias(f"n_{r.kind}") for r in secrets.RULES]
    return found.select("doc_id", *n, F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans"))


@register
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), threshold=0.7)


@register
def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_dedup(read_table(spark, sf_dir, "documents"), shingle=3, max_bits=3)


@register
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read_table(spark, sf_dir, "documents"),
                                     public_tokenizers.path("byte_bpe_50k.json"), limit=512)


@register
def op7_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_mil.quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), threshold=0.7)


@register
def op8_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"),
                        length=4096, end_id=2)


@register
def op9_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicates(read_table(spark, sf_dir, "embeddings"), threshold=0.9)


@register
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    trusted = read_table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality_rules.quality_rules(docs, trusted).drop("text")


@register
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"), most=16, scale=64)


@register
def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_contamination(docs, read_table(spark, sf_dir, "benchmark"), size=10)
    return found.select("doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"),
                        F.size("items").cast("long").alias("n_items"),
                        decontaminate.item_digest(F.col("items")).alias("items_sha256"),
                        (F.size("hits") > 0).alias("contaminated"))


@register
def op13_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return role_repair.repair_report(rows, role_repair.damage(rows))
