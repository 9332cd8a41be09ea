"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.session import checkpoint_dir

#: The only characters that separate words: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str = "text") -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` into the shared checkpoint folder and read it back.

    Cuts lineage like ``checkpoint()``, survives lost executors, and lets
    Catalyst see the real size: a join broadcasts it only if the size is
    below ``spark.sql.autoBroadcastJoinThreshold``."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remainder(col: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n`` (null id: 0)."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % F.lit(n), F.lit(0))


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def unit_hash(*cols: Column, seed: int = 0) -> Column:
    """A uniform number in [0, 1) from MD5 of the seed and the columns
    (52 bits), the same in any SQL engine."""
    key = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("null")) for c in cols])
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(2 ** 52))


_FOLDER: list[str] = []


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared checkpoint folder, or in the folder of the
    innermost ``scratch``."""
    return f"{_FOLDER[-1] if _FOLDER else checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession, label: str):
    """Tables written within lie in one folder, which is deleted at the end:
    what is kept must have been written elsewhere by then."""
    folder = shared_path(spark, label)
    _FOLDER.append(folder)
    try:
        yield folder
    finally:
        _FOLDER.remove(folder)
        delete(spark, folder)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Slots of a bitmap: at most 2^27 / 2^15 rows of 4 KB, 16 MB.
SLOTS = 1 << 27


def key_bits(keys: DataFrame, *cols: Column) -> DataFrame:
    """``(bucket, bits)``: a bitmap of the keys' hash slots.  Its size is
    bounded whatever the number of keys, so it may be broadcast; the more
    keys, the more others share their slots."""
    slot = F.pmod(F.xxhash64(*cols), F.lit(SLOTS)) + 1
    bits = keys.select(F.bitmap_bucket_number(slot).alias("bucket"), F.bitmap_bit_position(slot).alias("at"))
    return materialise(bits.groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bits")), "key-bits")


def may_hold(rows: DataFrame, bits: DataFrame, name: str, *cols: Column) -> DataFrame:
    """``rows`` with ``name``: false if no key of the bitmap equals the row's.
    Rows stay where they are, so a join need only move those of true."""
    slot = F.pmod(F.xxhash64(*cols), F.lit(SLOTS)) + 1
    at = F.bitmap_bit_position(slot).cast("int")
    keyed = rows.withColumn("_bucket", F.bitmap_bucket_number(slot)).withColumn("_at", at)
    found = keyed.join(F.broadcast(bits.select(F.col("bucket").alias("_bucket"), F.col("bits").alias("_bits"))), "_bucket", "left")
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright("_at", 3) + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.getbit(byte, F.col("_at") % 8) == 1
    return found.withColumn(name, F.coalesce(hit, F.lit(False))).drop("_bucket", "_at", "_bits")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: Catalyst would write a
    projected column out again inside a lambda, for each of its elements."""
    return F.get(F.transform(F.array(value), body), 0)


def by_group(batches: Iterator[pd.DataFrame], keys: list[str], fn) -> Iterator[pd.DataFrame]:
    """Apply ``fn`` to runs of equal keys in sorted batches."""
    rest: pd.DataFrame | None = None

    def groups(pdf: pd.DataFrame, last: bool):
        k = pdf[keys].to_numpy()
        cut = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
        at = np.concatenate([[0], cut, [len(pdf)]]) if len(pdf) else np.array([0])
        whole = len(at) - 1 if last else len(at) - 2
        out = [fn(pdf.iloc[at[i]:at[i + 1]]) for i in range(whole) if at[i + 1] - at[i] > 1]
        return [o for o in out if len(o)], pdf.iloc[at[whole]:] if not last else None
    for b in batches:
        pdf = b if rest is None else pd.concat([rest, b], ignore_index=True)
        out, rest = groups(pdf, False) if len(pdf) else ([], pdf)
        if out:
            yield pd.concat(out, ignore_index=True)
    if rest is not None and len(rest):
        out, _ = groups(rest, True)
        if out:
            yield pd.concat(out, ignore_index=True)
