"""Missing values, ties and limits that operators must not lose or hide."""

import pytest
from pyspark.sql import functions as F

from riskframe.functions.features import threshold_label
from riskframe.operators.cluster import davies_bouldin, silhouette
from riskframe.operators.models import fit_forest
from riskframe.operators.rank import average_rank, stratified_folds
from riskframe.operators.resample import smote
from riskframe.operators.stats import with_balanced_weight


@pytest.fixture(scope="module")
def frame(spark):
    return spark.range(50).select("id", F.when(F.col("id") % 5 != 0, F.col("id") % 2).alias("y"),
                                  F.when(F.col("id") % 5 != 1, F.col("id") / 7.0).alias("score"))


def test_folds_keep_rows_without_a_class(frame):
    out = stratified_folds(frame, "y", k=5, id_col="id")
    assert out.count() == 50 and out.where("fold is null").count() == 0


def test_rank_keeps_rows_without_a_score(frame):
    out = average_rank(frame, "score")
    assert out.count() == 50
    assert out.where("score is null and rank_pct is null").count() == 10
    assert out.agg(F.max("rank_pct")).first()[0] == 1.0
    by = average_rank(frame, "score", by=["y"])
    assert by.count() == 50 and by.where("y is null and score is not null and rank_pct is null").count() == 0


def test_balanced_weight_without_a_label(frame):
    out = with_balanced_weight(frame, "y")
    assert out.where("y is null and weight is null").count() == 10
    assert out.agg(F.sum("weight")).first()[0] == pytest.approx(40.0)


def test_nan_score_predicts_negative(spark):
    d = spark.createDataFrame([(float("nan"),), (0.7,)], "score double")
    assert [r[0] for r in d.select(threshold_label("score", 0.5)).collect()] == [0, 1]


def test_coincident_points(spark):
    pts = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(6)], "id long, x array<double>")
    lab = spark.createDataFrame([(i, i % 2) for i in range(6)], "id long, cluster int")
    assert silhouette(pts, lab).first()["silhouette"] == 0.0
    assert davies_bouldin(pts, lab).first()["davies_bouldin"] == 0.0


def test_limits_are_named(spark):
    d = spark.createDataFrame([(0, 1, 1.0), (1, 0, 2.0), (2, 0, 3.0), (3, 0, 4.0)], "id long, y int, a double")
    with pytest.raises(ValueError, match="limit of 30"):
        fit_forest(d, ["a"], max_depth=31)
    with pytest.raises(ValueError, match="two minority rows"):
        smote(d, "y", "id", ["a"])
