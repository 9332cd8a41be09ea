"""Outlier profile (the EDA entry): numeric columns -> IQR fences ->
outlier count per column, largest first.  Two Spark jobs for any number
of columns, against three scans per column in a per-column loop."""

from __future__ import annotations

from pyspark.sql import DataFrame

from riskframe.functions.features import numeric_columns
from riskframe.operators.stats import outlier_counts, sort_desc


def outlier_profile(df: DataFrame, k: float = 1.5, method: str = "exact") -> DataFrame:
    """``(feature, outlier_count)`` over every numeric column, sorted."""
    cols = numeric_columns(df)
    return sort_desc(outlier_counts(df, cols, k, method), "outlier_count", ["feature"])
