"""The append-only experiment log and per-stage state.

The log is a table of records, appended by one write job per batch of
records (no read-modify-write of a single file).  Re-runs stack up; the
current record per model is W3 (:func:`riskframe.operators.rank.latest_per_key`).
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.operators.rank import latest_per_key
from riskframe.session import checkpoint_dir, materialise

RESULTS_SCHEMA = T.StructType([
    T.StructField("model", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("threshold", T.DoubleType()),
    T.StructField("ROC_AUC", T.DoubleType()),
    T.StructField("PR_AUC", T.DoubleType()),
    T.StructField("F1", T.DoubleType()),
    T.StructField("Precision", T.DoubleType()),
    T.StructField("Recall", T.DoubleType()),
    T.StructField("Confusion_Matrix", T.ArrayType(T.ArrayType(T.LongType()))),
    T.StructField("notes", T.StringType()),
])

CORRUPT = "_corrupt_record"

STATE_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("stage", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("kv", T.MapType(T.StringType(), T.StringType())),
])


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    return os.path.join(checkpoint_dir(spark), f"riskframe-{name}-{uuid.uuid4().hex}")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _is_dir(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def read_results_log(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """S3: the log as a typed frame; a missing log is an empty frame.

    JSON is read permissively: a record that does not parse stays as a row of
    NULLs whose text is in ``_corrupt_record`` (only JSON has that column);
    ``corrupt_records`` counts them, ``parsed_records`` leaves them out."""
    if not _exists(spark, path):
        return spark.createDataFrame([], RESULTS_SCHEMA)
    if fmt == "json":
        # a single file holds one JSON array (the original log form); a folder
        # holds JSON Lines appended by `append_results(fmt="json")`
        schema = T.StructType([*RESULTS_SCHEMA.fields, T.StructField(CORRUPT, T.StringType())])
        parsed = (spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
                  .option("multiLine", not _is_dir(spark, path)).json(path))
        return materialise(parsed, "results-log")   # Spark does not count corrupt records while it parses
    return spark.read.schema(RESULTS_SCHEMA).parquet(path)


def parsed_records(log: DataFrame) -> DataFrame:
    """The records that parsed, without the corrupt-record column."""
    return log.where(F.col(CORRUPT).isNull()).drop(CORRUPT) if CORRUPT in log.columns else log


def corrupt_records(spark: SparkSession, path: str) -> DataFrame:
    """``(n_records, n_corrupt)`` of a JSON log."""
    log = read_results_log(spark, path, "json")
    bad = F.col(CORRUPT).isNotNull() if CORRUPT in log.columns else F.lit(False)
    return log.agg(F.count(F.lit(1)).alias("n_records"), F.count_if(bad).alias("n_corrupt"))


def append_results(records: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append records (e.g. from :func:`riskframe.operators.metrics.evaluate`)."""
    cols = []
    for f in RESULTS_SCHEMA.fields:
        if f.name in records.columns:
            cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
        elif f.name == "timestamp":
            cols.append(F.current_timestamp().alias("timestamp"))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    out = records.select(*cols)
    writer = out.write.mode("append")
    (writer.json(path) if fmt == "json" else writer.parquet(path))


def latest_results(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """W3 over the log: the current record per model."""
    return latest_per_key(parsed_records(read_results_log(spark, path, fmt)), ["model"], "timestamp")


def save_stage_state(spark: SparkSession, path: str, run_id: str, stage: str, kv) -> None:
    """Append ``(run_id, stage, ts, kv)``; ``kv`` is a dict or a one-row
    frame whose columns become the map (values as text)."""
    if isinstance(kv, DataFrame):
        m = F.create_map(*[x for c in kv.columns for x in (F.lit(c), F.col(c).cast("string"))])
        rec = kv.select(F.lit(run_id).alias("run_id"), F.lit(stage).alias("stage"),
                        F.current_timestamp().alias("ts"), m.alias("kv"))
    else:
        rec = spark.createDataFrame([(run_id, stage, {str(k): str(v) for k, v in kv.items()})],
                                    "run_id string, stage string, kv map<string,string>") \
            .select("run_id", "stage", F.current_timestamp().alias("ts"), "kv")
    rec.write.mode("append").parquet(path)


def load_stage_state(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    """S10 load: latest state per ``(run_id, stage)``; empty when missing."""
    if not _exists(spark, path):
        return spark.createDataFrame([], STATE_SCHEMA)
    df = spark.read.schema(STATE_SCHEMA).parquet(path)
    if run_id is not None:
        df = df.where(F.col("run_id") == run_id)
    return latest_per_key(df, ["run_id", "stage"], "ts")


def load_stage_dict(spark: SparkSession, path: str, run_id: str, stage: str) -> dict:
    """The latest state of one stage as a dict (``{}`` when absent)."""
    row = load_stage_state(spark, path, run_id).where(F.col("stage") == stage).first()
    return dict(row["kv"]) if row else {}
