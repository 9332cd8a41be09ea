"""Table readers.

Every reader converts float NaN to NULL on load: Spark aggregates treat
NaN as a value (``avg``/``percentile`` return NaN, ``NaN > x`` is true),
whereas the semantics we reproduce skip missing values.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _format_of(path: str) -> str:
    p = path.rstrip("/").lower()
    for ext, fmt in ((".csv", "csv"), (".tsv", "csv"), (".json", "json"),
                     (".parquet", "parquet"), (".orc", "orc")):
        if p.endswith(ext):
            return fmt
    return "parquet"


def nan_to_null(df: DataFrame) -> DataFrame:
    """Replace NaN by NULL in every float/double column (one projection)."""
    exprs: list[Column] = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            exprs.append(F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType)).alias(f.name))
        else:
            exprs.append(F.col(f.name))
    return df.select(*exprs)


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
               fmt: str | None = None, header: bool = True, sep: str | None = None) -> DataFrame:
    """Read a CSV / TSV / JSON / Parquet table, NaN -> NULL.

    Pass an explicit ``schema`` in production; CSV without one falls back to
    ``inferSchema`` (an extra pass over the file).
    """
    fmt = fmt or _format_of(path)
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        if sep is None and path.rstrip("/").lower().endswith(".tsv"):
            sep = "\t"
        reader = reader.option("header", header)
        if sep:
            reader = reader.option("sep", sep)
        if schema is None:
            reader = reader.option("inferSchema", True)
        df = reader.csv(path)
    elif fmt == "json":
        df = reader.option("multiLine", True).json(path)
    else:
        df = reader.format(fmt).load(path)
    return nan_to_null(df)


def read_optional(spark: SparkSession, path: str, label: str | None = None,
                  **kw) -> tuple[DataFrame | None, bool]:
    """``(df, has_label)``; ``(None, False)`` when the path is missing.

    Scoring steps downstream are skipped when the frame is ``None``; metric
    steps are skipped when the label column is absent.
    """
    if not _path_exists(spark, path):
        return None, False
    df = read_table(spark, path, **kw)
    return df, (label is not None and label in df.columns)


def _path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(jpath)


def with_row_id(df: DataFrame, keys: list[str] | None = None, name: str = "row_id",
                radix: int | None = None) -> DataFrame:
    """J1 support: a stable ``row_id`` assigned once, at load.

    With one integral key the key itself is used.  With two keys and a
    ``radix`` the id is ``major * radix + minor``; any other composite key
    becomes the text ``k1-k2-...``.  Without keys, ``monotonically_increasing_id`` is taken
    directly after the scan, before any shuffle, so it depends only on the
    file splits.
    """
    if keys:
        if len(keys) == 1:
            rid = F.col(keys[0]).cast("bigint")
        elif len(keys) == 2 and radix:
            rid = F.col(keys[0]).cast("bigint") * F.lit(radix) + F.col(keys[1]).cast("bigint")
        else:
            # composite natural key as text: never overflows, same text in SQL
            rid = F.concat_ws("-", *[F.col(k).cast("string") for k in keys])
    else:
        rid = F.monotonically_increasing_id()
    return df.withColumn(name, rid)


def driver_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the benchmark tables under ``sf_dir`` (NaN -> NULL)."""
    return read_table(spark, os.path.join(sf_dir, f"{name}.parquet"), fmt="parquet")
