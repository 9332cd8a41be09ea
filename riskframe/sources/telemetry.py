"""Per-iteration training telemetry.

Flat form: three TSV files with a header, ``learn_error.tsv (iter,
<metric>...)``, ``test_error.tsv (iter, <metric>...)`` and ``time_left.tsv
(iter, Passed, Remaining)``, joined on ``iter``.  Nested form: one JSON
document with ``meta`` and an ``iterations`` array of
``{iteration, learn[], test[], passed_time, remaining_time}``.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ITER_SCHEMA = T.StructType([
    T.StructField("meta", T.StructType([
        T.StructField("iteration_count", T.LongType()),
        T.StructField("test_sets", T.ArrayType(T.StringType())),
        T.StructField("learn_metrics", T.ArrayType(T.StructType([T.StructField("name", T.StringType())]))),
        T.StructField("test_metrics", T.ArrayType(T.StructType([T.StructField("name", T.StringType())]))),
    ])),
    T.StructField("iterations", T.ArrayType(T.StructType([
        T.StructField("iteration", T.LongType()),
        T.StructField("learn", T.ArrayType(T.DoubleType())),
        T.StructField("test", T.ArrayType(T.DoubleType())),
        T.StructField("passed_time", T.DoubleType()),
        T.StructField("remaining_time", T.DoubleType()),
    ]))),
])


def _tsv(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    df = spark.read.option("sep", "\t").option("header", True).option("inferSchema", True).csv(path)
    return df.select(F.col("iter").cast("long").alias("iter"),
                     *[F.col(c).alias(f"{prefix}{c}") for c in df.columns if c != "iter"])


def read_training_curves(spark: SparkSession, folder: str) -> DataFrame:
    """``(iter, learn_<m>..., test_<m>..., Passed, Remaining)``."""
    learn = _tsv(spark, os.path.join(folder, "learn_error.tsv"), "learn_")
    test = _tsv(spark, os.path.join(folder, "test_error.tsv"), "test_")
    tl = _tsv(spark, os.path.join(folder, "time_left.tsv"), "")
    return learn.join(test, "iter", "full").join(tl, "iter", "left")


def read_training_json(spark: SparkSession, path: str) -> DataFrame:
    """One row per iteration ``(iteration, learn_0, test_0, passed_time,
    remaining_time)``."""
    doc = spark.read.schema(ITER_SCHEMA).option("multiLine", True).json(path)
    it = doc.select(F.explode("iterations").alias("i"))
    return it.select(F.col("i.iteration").alias("iteration"),
                     F.element_at("i.learn", 1).alias("learn_0"), F.element_at("i.test", 1).alias("test_0"),
                     F.col("i.passed_time").alias("passed_time"), F.col("i.remaining_time").alias("remaining_time"))


def write_training_curves(curve: DataFrame, folder: str, learn: str, test: str,
                          metric: str = "Logloss", test_metric: str = "AUC") -> None:
    """Write a ``(iter, learn, test, passed, remaining)`` curve in the flat
    three-file layout (one small file each)."""
    def one(df, name):
        df.coalesce(1).write.mode("overwrite").option("sep", "\t").option("header", True) \
            .csv(os.path.join(folder, name))
    one(curve.select("iter", F.col(learn).alias(metric)), "learn_error.tsv")
    one(curve.select("iter", F.col(test).alias(test_metric)), "test_error.tsv")
    one(curve.select("iter", F.col("passed").alias("Passed"), F.col("remaining").alias("Remaining")), "time_left.tsv")


def write_training_json(curve: DataFrame, path: str, learn: str, test: str) -> None:
    """Write the nested one-document JSON form of a curve."""
    it = F.sort_array(F.collect_list(F.struct(
        F.col("iter").alias("iteration"), F.array(F.col(learn)).alias("learn"),
        F.array(F.col(test)).alias("test"), F.col("passed").cast("double").alias("passed_time"),
        F.col("remaining").cast("double").alias("remaining_time"))))
    doc = curve.agg(F.struct(F.count(F.lit(1)).alias("iteration_count")).alias("meta"), it.alias("iterations"))
    doc.coalesce(1).write.mode("overwrite").json(path)
