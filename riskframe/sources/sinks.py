"""Prediction, feature-importance and label exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.functions.features import threshold_label


def write_predictions(scores: DataFrame, path: str, fmt: str = "csv", threshold: float | None = None) -> None:
    """``(y_true, y_prob)``, or ``(Class_proba, Class_pred)`` when a
    threshold is given (label absent in the scored file)."""
    if threshold is None:
        out = scores.select(F.col("y").cast("int").alias("y_true"), F.col("score").alias("y_prob"))
    else:
        out = scores.select(F.col("score").alias("Class_proba"),
                            threshold_label("score", threshold).alias("Class_pred"))
    w = out.write.mode("overwrite")
    (w.option("header", True).csv(path) if fmt == "csv" else w.parquet(path))


def write_feature_importance(importance: DataFrame, path: str) -> None:
    """``(feature, importance)`` largest first, one small CSV file."""
    (importance.orderBy(F.col("importance").desc(), F.col("feature")).coalesce(1)
     .write.mode("overwrite").option("header", True).csv(path))


def export_labels(src: DataFrame, labels: DataFrame, key: str, label_col: str, name: str,
                  default: int | None = None) -> DataFrame:
    """Every source row kept, the label attached by a keyed LEFT join
    (a row without a label gets ``default``)."""
    lab = labels.select(key, F.col(label_col).alias(name))
    out = src.join(lab, key, "left")
    if default is not None:
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit(default)))
    return out
