"""P-series: derived columns and projections.

All builders return ``Column`` expressions or do a single ``select``; wide
feature sets are emitted in one projection (never a ``withColumn`` chain).
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

__all__ = [
    "drop_cols", "select_except", "numeric_columns", "slice_columns",
    "log_amount", "second_of_day", "hour_of_day", "cyclic", "cyclic_time",
    "cyclic_hour", "cross_with", "row_norm", "array_norm", "norm_powers",
    "pairwise_products", "squares", "safe_ratio", "clip", "threshold_label",
    "class_weight", "with_features",
]


def c_(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---- P1-P4 projections ---------------------------------------------------

def drop_cols(df: DataFrame, cols: list[str]) -> DataFrame:
    """Drop columns, ignoring names that are not present."""
    return df.drop(*cols)


def select_except(df: DataFrame, pred) -> DataFrame:
    """Keep the columns whose name satisfies ``pred(name)``."""
    return df.select(*[c for c in df.columns if pred(c)])


def numeric_columns(df: DataFrame) -> list[str]:
    """Names of numeric columns (schema only, no job)."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def slice_columns(df: DataFrame, i: int, j: int) -> DataFrame:
    """Positional column slice ``[i:j]``."""
    return df.select(*df.columns[i:j])


# ---- P6-P9 amount and time -----------------------------------------------

def log_amount(x) -> Column:
    """``log1p``; NULL where the argument is <= -1."""
    return F.log1p(c_(x))


def second_of_day(ts) -> Column:
    """Seconds since midnight of a timestamp (zone-free arithmetic)."""
    t = c_(ts)
    return (F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)).cast("double")


def hour_of_day(seconds) -> Column:
    """``(t % 86400) // 3600`` with a non-negative modulus."""
    return F.floor(F.pmod(c_(seconds), F.lit(86400)) / 3600).cast("double")


def cyclic(x, period: float) -> tuple[Column, Column]:
    """sin / cos of ``2 pi x / period``."""
    a = F.lit(2 * math.pi) * c_(x) / F.lit(float(period))
    return F.sin(a), F.cos(a)


def cyclic_time(seconds) -> tuple[Column, Column]:
    """sin/cos of the second of day (period 86400)."""
    return cyclic(seconds, 86400.0)


def cyclic_hour(hour) -> tuple[Column, Column]:
    """sin/cos of the integer hour (period 24)."""
    return cyclic(hour, 24.0)


# ---- P10-P15 crosses, norms, products ------------------------------------

def cross_with(base, cols: list[str], prefix: str) -> list[Column]:
    """``base * c`` for each column, named ``<prefix><c>``."""
    b = c_(base)
    return [(b * F.col(c)).alias(f"{prefix}{c}") for c in cols]


def row_norm(cols: list[str]) -> Column:
    """L2 norm over a list of columns."""
    return F.sqrt(sum((F.col(c) * F.col(c) for c in cols), F.lit(0.0)))


def array_norm(arr) -> Column:
    """P11 for an ``array<float|double>`` column."""
    return F.sqrt(F.aggregate(c_(arr), F.lit(0.0), lambda acc, v: acc + v.cast("double") * v))


def norm_powers(norm, powers=(2, 3), name: str = "V_norm") -> list[Column]:
    """``norm ** k``."""
    return [F.pow(c_(norm), F.lit(float(k))).alias(f"{name}_pow{k}") for k in powers]


def pairwise_products(cols: list[str]) -> list[Column]:
    """All i<j products, named ``<a>_x_<b>``."""
    return [(F.col(a) * F.col(b)).alias(f"{a}_x_{b}") for a, b in itertools.combinations(cols, 2)]


def squares(cols: list[str]) -> list[Column]:
    """``c * c`` named ``<c>_sq``."""
    return [(F.col(c) * F.col(c)).alias(f"{c}_sq") for c in cols]


def safe_ratio(a, b) -> Column:
    """``a / (b + 1)``; NULL instead of an ANSI divide-by-zero error."""
    return F.try_divide(c_(a), c_(b) + F.lit(1.0))


# ---- P17-P19 -------------------------------------------------------------

def _val(v) -> Column:
    return c_(v) if isinstance(v, (str, Column)) else F.lit(float(v))


def clip(x, lo=None, hi=None) -> Column:
    """Bound values; NULL stays NULL (``least``/``greatest`` would
    replace a NULL by the bound)."""
    col = c_(x)
    branches = []
    if hi is not None:
        branches.append((col > _val(hi), _val(hi)))
    if lo is not None:
        branches.append((col < _val(lo), _val(lo)))
    if not branches:
        return col
    expr = F.when(*branches[0])
    for cond, val in branches[1:]:
        expr = expr.when(cond, val)
    return expr.otherwise(col)


def threshold_label(score, t) -> Column:
    """``score >= t`` as 0/1 (inclusive); a NaN score gives 0 (Spark
    would order NaN above every number), a NULL score stays NULL."""
    sc = c_(score).cast("double")
    return ((sc >= (t if isinstance(t, Column) else F.lit(float(t)))) & ~F.isnan(sc)).cast("int")


def class_weight(y, ratio) -> Column:
    """``neg/pos`` for the positive class, 1.0 otherwise."""
    r = ratio if isinstance(ratio, Column) else F.lit(float(ratio))
    return F.when(c_(y) == 1, r).otherwise(F.lit(1.0))


def with_features(df: DataFrame, exprs: list[Column], keep: list[str] | None = None) -> DataFrame:
    """Append many generated columns in ONE projection."""
    base = [F.col(c) for c in (keep if keep is not None else df.columns)]
    return df.select(*base, *exprs)
