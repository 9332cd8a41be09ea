from pyspark.sql import functions as F

from riskframe.functions.catalogue import CATALOGUE, build_feature_set
from riskframe.plans.catalog_stats import card_frame
from tests.conftest import SF01


def test_feature_set_sizes_match_the_logged_counts(spark):
    card = card_frame(spark, SF01)
    sizes = {n: len(build_feature_set(card, spec)[1]) for n, spec in CATALOGUE.items()}
    assert sizes == {"T1_eng": 41, "T1_raw": 28, "T2": 42, "T3": 40, "T4": 55, "T5_A": 38, "T5_B": 56, "T6_A": 43, "T6_B": 62,
                     "T7_A": 49, "T7_B": 77, "T8_A": 49, "T8_B": 71, "T9_A": 89, "T9_B": 101}


def test_statistics_come_from_the_training_frame(spark):
    """z-score, bins and scaler of a test frame are those of the training
    frame, whatever the test frame holds."""
    card = card_frame(spark, SF01)
    train, test = card.where("row_id % 2 = 0"), card.where("row_id % 2 = 1").withColumn("Amount", F.col("Amount") * 50)
    for name, col in (("T2", "amt_zscore"), ("T3", "Amount_bin"), ("T4", "Amount")):
        alone = build_feature_set(train, CATALOGUE[name])[0].select("row_id", F.col(col).alias("a"))
        again = build_feature_set(train, CATALOGUE[name], fit_on=train)[0].select("row_id", F.col(col).alias("b"))
        assert alone.join(again, "row_id").where("a <=> b").count() == train.count()
        own = build_feature_set(test, CATALOGUE[name])[0].select("row_id", F.col(col).alias("a"))
        fitted = build_feature_set(test, CATALOGUE[name], fit_on=train)[0].select("row_id", F.col(col).alias("b"))
        assert own.join(fitted, "row_id").where("not (a <=> b)").count() > 0.5 * test.count()


def test_feature_set_is_one_projection(spark):
    built, _ = build_feature_set(card_frame(spark, SF01), CATALOGUE["T1_eng"])
    plan = built._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Project [") <= 2  # read-side NaN->NULL projection + the feature projection
