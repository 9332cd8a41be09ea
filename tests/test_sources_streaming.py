import os
import tempfile

import pytest
from pyspark.sql import functions as F

from riskframe.operators import metrics as mt
from riskframe.operators import stats as st
from riskframe.sources import logs, read_optional, read_table, telemetry
from riskframe.streaming import apply_frozen, freeze_stats
from tests.conftest import SF01


def test_read_table_nan_to_null_and_optional(spark):
    d = tempfile.mkdtemp(prefix="rf-src-")
    p = os.path.join(d, "t.csv")
    with open(p, "w") as f:
        f.write("a,b\n1.0,NaN\n2.0,3.0\n")
    df = read_table(spark, p, schema="a double, b double")
    assert [r.b for r in df.orderBy("a").collect()] == [None, 3.0]
    missing, has = read_optional(spark, os.path.join(d, "nope.csv"), label="b")
    assert missing is None and not has
    got, has = read_optional(spark, p, label="b", schema="a double, b double")
    assert has and got.count() == 2


def test_results_log_roundtrip_and_latest(spark):
    path = logs.scratch_path(spark, "test-log")
    assert logs.read_results_log(spark, path).count() == 0
    s = spark.createDataFrame([(1, "m", 1, 0.9), (2, "m", 0, 0.1), (3, "m", 1, 0.4)],
                              "row_id long, model string, y int, score double")
    rec = mt.evaluate(s, 0.5, notes="t")
    logs.append_results(rec, path)
    logs.append_results(rec.withColumn("notes", F.lit("rerun")), path)
    assert logs.read_results_log(spark, path).count() == 2
    latest = logs.latest_results(spark, path).collect()
    assert len(latest) == 1 and latest[0].notes in ("t", "rerun")
    assert latest[0].Confusion_Matrix == [[1, 0], [1, 1]]


def test_json_log_drops_corrupt_records(spark):
    d = tempfile.mkdtemp(prefix="rf-json-")
    p = os.path.join(d, "log.json")
    with open(p, "w") as f:
        f.write('[{"model": "a", "ROC_AUC": 0.9, "Confusion_Matrix": [[1, 2], [3, 4]], "notes": "x"}]')
    df = logs.read_results_log(spark, p, fmt="json")
    r = df.first()
    assert r.model == "a" and r.Confusion_Matrix == [[1, 2], [3, 4]]


def test_stage_state_latest_wins(spark):
    path = logs.scratch_path(spark, "test-state")
    assert logs.load_stage_dict(spark, path, "r", "s") == {}
    logs.save_stage_state(spark, path, "r", "s", {"best": 0.5})
    logs.save_stage_state(spark, path, "r", "s", {"best": 0.7, "depth": 4})
    assert logs.load_stage_dict(spark, path, "r", "s") == {"best": "0.7", "depth": "4"}


def test_telemetry_roundtrip_and_best_iteration(spark):
    folder = logs.scratch_path(spark, "test-telemetry")
    vals = [0.5, 0.6, 0.7, 0.65, 0.7, 0.6]
    curve = spark.createDataFrame([(i, 1.0 - v, v, i * 10, (5 - i) * 10) for i, v in enumerate(vals)],
                                  "iter long, learn double, test double, passed long, remaining long")
    telemetry.write_training_curves(curve, folder, "learn", "test", "Logloss", "AUC")
    telemetry.write_training_json(curve, os.path.join(folder, "t.json"), "learn", "test")
    flat = telemetry.read_training_curves(spark, folder)
    assert flat.count() == 6 and "test_AUC" in flat.columns and "Passed" in flat.columns
    b = st.best_iteration(flat, "iter", "test_AUC").first()
    assert (b.best_iter, b.last_iter, b.patience) == (2, 5, 3)
    nested = telemetry.read_training_json(spark, os.path.join(folder, "t.json"))
    assert st.best_iteration(nested, "iteration", "test_0").first().best_iter == 2


def test_streaming_applies_frozen_stats(spark):
    ev = spark.read.parquet(os.path.join(SF01, "events.parquet")).select("event_id", "value")
    caps = freeze_stats(st.fit_quantile_cap(ev, ["value"], 0.99))
    scaler = freeze_stats(st.fit_robust_scaler(ev, ["value"]))
    batch = apply_frozen(ev, caps, scaler).orderBy("event_id").collect()
    stream = (spark.readStream.schema("event_id long, value double")
              .option("pathGlobFilter", "events.parquet").parquet(SF01))
    q = (apply_frozen(stream, caps, scaler).writeStream.format("memory").queryName("rf_stream_test")
         .outputMode("append").start())
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    streamed = spark.sql("SELECT * FROM rf_stream_test ORDER BY event_id").collect()
    assert len(streamed) == len(batch)
    assert all(a.value == pytest.approx(b.value) for a, b in zip(streamed, batch))


def test_json_log_append_roundtrip(spark):
    path = logs.scratch_path(spark, "test-json-log")
    s = spark.createDataFrame([(1, "m", 1, 0.9), (2, "m", 0, 0.1)], "row_id long, model string, y int, score double")
    rec = mt.evaluate(s, 0.5, notes="json")
    logs.append_results(rec, path, fmt="json")
    logs.append_results(rec, path, fmt="json")
    back = logs.read_results_log(spark, path, fmt="json")
    assert back.count() == 2 and back.first().Confusion_Matrix == [[1, 0], [0, 1]]
