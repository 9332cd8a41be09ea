"""The corpus pipeline: quality rules, near-duplicates, secrets, mixing,
packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame, which is written as Parquet and read again as the
next stage's ``docs``.  All but the last return the columns of documents.

Defined results.  A null text counts as empty.  Extra columns of documents
pass through all stages but the last, also those named like an operator's own.
Rows of the same id are separate
documents, but of a near-duplicate group only one row stays.  An empty table
gives an empty result.
"""

from __future__ import annotations

from functools import reduce

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm import mixing, packing, quality_rules, secrets, simhash
from riskframe.llm.base import delete, key_bits, materialise, may_hold, read_table, scratch, shared_path, text_of


def apart(docs: DataFrame, *need: str):
    """``docs`` with names for its other columns that no operator uses, and
    what gives them back."""
    names = {c: c if c in need else f"_own{i}" for i, c in enumerate(docs.columns)}
    inside = docs.select(*[F.col(c).alias(n) for c, n in names.items()])
    return inside, lambda df: df.select(*[F.col(n).alias(c) for c, n in names.items()])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    trusted = read_table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    docs, back = apart(docs, "doc_id", "text")
    return back(quality_rules.quality_rules(docs, trusted).where("kept"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash component: that of its smallest id (rows
    without one come last), of several texts of this id the one of the
    smallest SHA-256, and any one of equal rows.

    Only texts that may be in a component of several rows are moved."""
    docs, back = apart(docs, "doc_id", "text")
    key = [F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.sha2(text_of("text"), 256).alias("sha")]
    found = simhash.simhash_dedup(docs.select(F.struct(*key).alias("_key"), "text"), shingle=3, max_bits=3, id_col="_key")
    found = materialise(found.select(F.col("doc_id").alias("key"), F.col("component_id").alias("comp")), "dedup-found")
    groups = found.groupBy("comp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("comp")
    marks = (found.join(groups, "comp").groupBy("key").agg(F.first(F.col("key") == F.col("comp")).alias("stays"))
             .select("key.id", "key.sha", "stays"))
    marks = materialise(marks, "dedup-marks")
    row_key = [F.col("doc_id"), F.sha2(text_of("text"), 256)]
    rows = may_hold(docs, key_bits(marks, F.col("id"), F.col("sha")), "_moved", *row_key)
    moved = rows.where("_moved").withColumn("_sha", row_key[1])
    same = moved["doc_id"].eqNullSafe(marks["id"]) & (moved["_sha"] == marks["sha"])
    moved = materialise(moved.join(marks, same, "left").where("stays is null or stays"), "dedup-moved")
    one = moved.where("stays").dropDuplicates(["doc_id", "_sha"])
    out = [rows.where("not _moved"), moved.where("stays is null"), one]
    return back(reduce(DataFrame.unionByName, [x.select(*docs.columns) for x in out]))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every secret replaced; ``n_chars`` follows the text."""
    docs, back = apart(docs, "text", "n_chars")
    found = secrets.scan_secrets(docs, shared_path(spark, "secret-ledger"))
    text = F.when(F.size("findings") == 0, F.col("text")).otherwise(secrets.redact(F.col("text"), F.col("findings")))
    out = found.withColumn("text", text)
    if "n_chars" in docs.columns:
        n = F.when(F.size("findings") == 0, F.col("n_chars")).otherwise(F.length("text"))
        out = out.withColumn("n_chars", n.cast(docs.schema["n_chars"].dataType))
    return back(out)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents by tempered source weight, shuffled."""
    docs, back = apart(docs, "doc_id", "text", "source")
    return back(mixing.mix_sources(docs, temper=0.5, epochs=1.0, seed=1))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens."""
    return packing.pack(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), length=4096, end_id=2)


STAGES = [
    ("quality rules", quality_stage),
    ("simhash near-dedup", near_dedup_stage),
    ("secret scans", secrets_stage),
    ("mixing sources", mixing_stage),
    ("packing", packing_stage),
]

#: Packing tokenises, which SQL cannot express; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's own tables go once its output is written, and each
    output once the next is; the last stage is left to the caller."""
    docs, path = read_table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES[:-1]):
        out = shared_path(spark, f"stage-{i}")
        with scratch(spark, "stage-tables"):
            stage(spark, docs, sf_dir).write.parquet(out)
        if path:
            delete(spark, path)
        docs, path = spark.read.parquet(out), out
    return STAGES[-1][1](spark, docs, sf_dir)
