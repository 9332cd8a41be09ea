"""Shared fixtures for registered queries: driver tables, row ids, rounding.

Every registered query reads whole driver tables (or frames Spark derives
from them); no id subsets, samples or row caps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.sources.tables import driver_table, with_row_id

LINEITEM_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_linestatus"]
ROW_ID_SQL = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linestatus)"
LINEITEM_V = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return driver_table(spark, sf, name)


def lineitem(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem with ``row_id = 'orderkey-linenumber-partkey-suppkey-linestatus'``
    (``(l_orderkey, l_linenumber)`` alone repeats in the driver data)."""
    return with_row_id(table(spark, sf, "lineitem"), LINEITEM_KEY)


def round_half_away(x, digits: int = 6):
    """``x`` rounded to ``digits`` decimals, half away from zero, on the
    binary value: ``signum(x) * floor(|x| * 10^d + 0.5) / 10^d``.

    Branch-free arithmetic (code-generated, the input evaluated once),
    where ``F.round`` converts every value to a BigDecimal; it rounds the
    way SQL engines round doubles in binary.  NaN and +-inf pass through."""
    scale = F.lit(float(10 ** digits))
    return F.signum(x) * F.floor(F.abs(x) * scale + F.lit(0.5)) / scale


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every float/double column (and doubles nested in arrays)."""
    out = []
    for f in df.schema.fields:
        dt = f.dataType
        if isinstance(dt, (T.DoubleType, T.FloatType)):
            out.append(round_half_away(F.col(f.name).cast("double"), digits).alias(f.name))
        elif isinstance(dt, T.ArrayType) and isinstance(dt.elementType, (T.DoubleType, T.FloatType)):
            out.append(F.transform(F.col(f.name), lambda v: round_half_away(v.cast("double"), digits)).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def sql_round(cols: list[str], digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in cols)
