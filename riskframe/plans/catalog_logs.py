"""Registered queries: sources and sinks round trips (S3-S10), the log's
latest record per model (W3) and best-iteration analysis (A28).

Every round trip writes into a fresh folder under the session's shared
``spark.checkpoint.dir`` and reads the result back.
"""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from riskframe.operators import metrics as mt
from riskframe.operators import models as md
from riskframe.operators import stats as st
from riskframe.plans.catalog_metrics import LIN200, LONG_SQL, _rank_metrics_sql, _sweep_sql, long_scores
from riskframe.plans.catalog_models import GBT, split
from riskframe.plans.common import LINEITEM_V, round_doubles, table
from riskframe.plans.registry import ORACLE, QUERIES, register
from riskframe.sources import logs, sinks, telemetry


@register("s3_s4_w3_results_log_lineitem")
def s3_s4_w3_results_log_lineitem(spark, sf):
    path = logs.scratch_path(spark, "results-log")
    rec = mt.evaluate(long_scores(spark, sf), 0.5, notes="score >= 0.5", with_timestamp=False)
    logs.append_results(rec, path)          # first run
    logs.append_results(rec, path)          # a re-run stacks up
    return logs.latest_results(spark, path).drop("timestamp")


@register("s10_stage_state_lineitem",
          f"""WITH m AS ({_rank_metrics_sql(LONG_SQL)})
              SELECT 'run-1' AS run_id, model AS stage, roc_auc, pr_auc FROM m""")
def s10_stage_state_lineitem(spark, sf):
    path = logs.scratch_path(spark, "stage-state")
    aucs = round_doubles(mt.ranking_metrics(long_scores(spark, sf)))
    for m in ("price", "discount", "quantity"):
        # an earlier save of the same stage is superseded by the later one
        logs.save_stage_state(spark, path, "run-1", m, {"roc_auc": "0", "pr_auc": "0"})
        logs.save_stage_state(spark, path, "run-1", m,
                              aucs.where(F.col("model") == m).select("roc_auc", "pr_auc"))
    st_ = logs.load_stage_state(spark, path, "run-1")
    return st_.select("run_id", "stage", F.col("kv")["roc_auc"].cast("double").alias("roc_auc"),
                      F.col("kv")["pr_auc"].cast("double").alias("pr_auc"))


@register("s5_write_predictions_lineitem",
          f"WITH {LONG_SQL} SELECT y AS y_true, round(score, 6) AS y_prob FROM s WHERE model = 'price'")
def s5_write_predictions_lineitem(spark, sf):
    path = logs.scratch_path(spark, "predictions")
    sc = round_doubles(long_scores(spark, sf).where(F.col("model") == "price"))
    sinks.write_predictions(sc, path)
    return spark.read.schema("y_true int, y_prob double").option("header", True).csv(path)


@register("s3_s4_json_log_lineitem",
          f"""WITH m AS ({_rank_metrics_sql(LONG_SQL)})
              SELECT model, round(roc_auc, 6) AS "ROC_AUC", 2::BIGINT AS n_corrupt, 5::BIGINT AS n_records FROM m""")
def s3_s4_json_log_lineitem(spark, sf):
    """A JSON log with two broken records: both are counted, the others read."""
    path = logs.scratch_path(spark, "results-json")
    rec = mt.evaluate(long_scores(spark, sf), 0.5, notes="score >= 0.5", with_timestamp=False)
    logs.append_results(rec, path, fmt="json")
    spark.range(2).select(F.concat(F.lit('{"model": "broken-'), "id", F.lit('", "ROC_AUC": '))).write.mode("append").text(path)
    n = logs.corrupt_records(spark, path).first()
    return logs.latest_results(spark, path, "json").select(
        "model", "ROC_AUC", F.lit(n.n_corrupt).cast("bigint").alias("n_corrupt"),
        F.lit(n.n_records).cast("bigint").alias("n_records"))


@register("s6_write_feature_importance_lineitem", ORACLE["a5_outlier_counts_lineitem"].join(
    ("SELECT feature, outlier_count::DOUBLE AS importance, (row_number() OVER (ORDER BY outlier_count DESC, feature) - 1)::BIGINT AS line FROM (", ")")))
def s6_write_feature_importance_lineitem(spark, sf):
    """Outlier counts as importances: written, and read back line by line."""
    path = logs.scratch_path(spark, "importance")
    found = QUERIES["a5_outlier_counts_lineitem"](spark, sf)
    sinks.write_feature_importance(found.select("feature", F.col("outlier_count").cast("double").alias("importance")), path)
    back = spark.read.schema("feature string, importance double").option("header", True).csv(path)
    return back.withColumn("line", F.monotonically_increasing_id())


@register("s7_export_labels_documents",
          "SELECT d.doc_id, d.lang, d.n_chars, coalesce(l.quality, -1) AS quality_label "
          "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def s7_export_labels_documents(spark, sf):
    path = logs.scratch_path(spark, "labels-export")
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    out = sinks.export_labels(docs, table(spark, sf, "labels"), "doc_id", "quality", "quality_label", default=-1)
    out.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@register("a28_best_iteration_sweep_lineitem",
          _sweep_sql(LIN200) + f""", f AS (SELECT model, t_idx, {'CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE (2 * tp)::DOUBLE / (2 * tp + fp + fn) END'} AS f1 FROM x)
              SELECT model, arg_min(t_idx, (-f1, t_idx)) AS best_iter, round(max(f1), 6) AS best_value,
                     max(t_idx) AS last_iter, max(t_idx) - arg_min(t_idx, (-f1, t_idx)) AS patience FROM f GROUP BY model""")
def a28_best_iteration_sweep_lineitem(spark, sf):
    sweep = mt.threshold_sweep(long_scores(spark, sf), LIN200)
    return round_doubles(st.best_iteration(sweep, "t_idx", "f1", ["model"]))


@register("s8_s9_a28_training_curves_lineitem")
def s8_s9_a28_training_curves_lineitem(spark, sf):
    """The curve of a boosted model fitted with patience (log-loss on train
    and on held-out rows, measured times), written in the flat TSV and nested
    JSON layouts and read back; the first best iteration found on each."""
    train, test = split(spark, sf)
    fitted = md.boost_with_patience(train, test, LINEITEM_V, max_iter=12, patience=3, step=0.2, maxDepth=3)
    curve = fitted.curve
    folder = logs.scratch_path(spark, "telemetry")
    telemetry.write_training_curves(curve, folder, "learn", "test", "Logloss", "Logloss")
    telemetry.write_training_json(curve, os.path.join(folder, "training.json"), "learn", "test")
    flat = telemetry.read_training_curves(spark, folder).select(
        F.lit("tsv").alias("source"), F.col("iter"), F.col("test_Logloss").alias("loss"))
    nested = telemetry.read_training_json(spark, os.path.join(folder, "training.json")).select(
        F.lit("json").alias("source"), F.col("iteration").alias("iter"), F.col("test_0").alias("loss"))
    both = flat.unionByName(nested)
    return round_doubles(st.best_iteration(both, "iter", "loss", ["source"], maximize=False))


# the log round trip must return exactly the A23 records
ORACLE["s3_s4_w3_results_log_lineitem"] = ORACLE["a23_evaluate_lineitem"]
