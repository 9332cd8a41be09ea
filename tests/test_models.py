"""Model operators (M1-M9, S6): invariants that hold whatever the learner."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.operators import models as md

X = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3))
    p = 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1])))
    return x, (rng.uniform(size=400) < p).astype(int)


@pytest.fixture(scope="module")
def frame(spark, rows):
    x, y = rows
    d = spark.createDataFrame([(i, int(y[i]), *map(float, x[i])) for i in range(len(y))], "row_id long, y int, a double, b double, c double")
    return d.withColumn("fold", (F.col("row_id") % 4).cast("int")).cache()


def boosted(d, seed=1):
    return md.fit_boosted(d, X, maxIter=3, maxDepth=2, seed=seed, subsamplingRate=0.7)


def auc(scores):
    s = sorted((r["score"], r["y"]) for r in scores.collect())
    pos, neg = [v for v, y in s if y], [v for v, y in s if not y]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def test_assemble_keeps_label_and_order(frame):
    r = md.assemble(frame, ["c", "a"]).where("row_id = 7").first()
    assert r["features"].toArray().tolist() == [r["c"], r["a"]] and r["y"] in (0, 1)


def test_logistic_meets_its_optimality_condition(frame, rows):
    x, y = rows
    m = md.fit_logistic(frame, X, C=0.1, max_iter=500)
    w, b = m.coefficients.toArray(), m.intercept
    p = 1 / (1 + np.exp(-(x @ w + b)))
    # gradient of 0.5 |w|^2 + C * sum of losses; the intercept is not penalised
    assert np.abs(w - 0.1 * x.T @ (y - p)).max() < 1e-2
    assert abs((y - p).sum()) < 1e-2


def test_forest_refuses_depth_it_cannot_reach(frame):
    with pytest.raises(ValueError):
        md.fit_forest(frame, X, max_depth=31)


def test_importance_lists_every_feature_and_sums_to_one(frame):
    m = md.fit_forest(frame, X, n_trees=5, max_depth=3)
    r = md.feature_importance(m, X).collect()
    assert sorted(x["feature"] for x in r) == X and r[0]["feature"] == "a"
    assert sum(x["importance"] for x in r) == pytest.approx(1)


def test_oof_scores_each_row_by_a_model_that_did_not_see_it(frame):
    oof, test = md.oof_scores(frame, X, boosted, k=4, test=frame)
    got = {r["row_id"]: r["score"] for r in oof.collect()}
    assert len(got) == oof.count() == 400 and 0.7 < auc(oof) < 1
    ms = [boosted(frame.where(F.col("fold") != k)) for k in range(4)]
    per = [{r["row_id"]: r["score"] for r in md.predict_proba(m, frame, X).collect()} for m in ms]
    assert all(got[i] == pytest.approx(per[i % 4][i]) and 0 <= got[i] <= 1 for i in got)
    mean = {r["row_id"]: r["score"] for r in test.collect()}
    assert all(mean[i] == pytest.approx(np.mean([p[i] for p in per])) for i in got)


def test_seed_average_is_the_mean_of_its_models(frame):
    avg, spread = md.seed_average(frame, frame, X, boosted, [1, 2])
    per = [{r["row_id"]: r["score"] for r in md.predict_proba(boosted(frame, s), frame, X).collect()} for s in (1, 2)]
    assert all(r["score"] == pytest.approx((per[0][r["row_id"]] + per[1][r["row_id"]]) / 2) for r in avg.collect())
    assert set(spread.first()["auc_by_seed"]) == {"seed_1", "seed_2"}


def test_random_search_keeps_the_best_trial(frame):
    space = {"maxDepth": ("int", 1, 3), "stepSize": ("loguniform", 0.01, 0.5)}
    trials, best, model = md.random_search(frame, frame, X, lambda d, p: md.fit_boosted(d, X, maxIter=2, **p), space, 3)
    r = trials.collect()
    top = max(r, key=lambda t: t["roc_auc"])
    assert len(r) == 3 and top["params"] == {k: str(v) for k, v in best.items()}
    assert auc(md.predict_proba(model, frame, X)) == pytest.approx(top["roc_auc"], abs=1e-6)
    assert md.sample_params(space, 3) == md.sample_params(space, 3)


def test_ablation_scores_the_held_out_fold_once_per_set(frame):
    sets = {"signal": ["a", "b"], "noise": ["c"]}
    out = md.ablation({k: frame for k in sets}, lambda d, f: md.fit_logistic(d, f, C=1.0), sets)
    assert {(r["model"], r["count"]) for r in out.groupBy("model").count().collect()} == {("signal", 100), ("noise", 100)}
    assert auc(out.where("model = 'signal'")) > auc(out.where("model = 'noise'")) + 0.1


def test_boosting_with_patience_keeps_the_first_best_trees(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.random() < 1 / (1 + np.exp(-3 * x))), float(x), float(z)) for i, (x, z) in enumerate(rng.normal(size=(600, 2)))]
    df = spark.createDataFrame(rows, "row_id long, y int, a double, b double")
    train, valid = df.where("row_id % 2 = 0"), df.where("row_id % 2 = 1")
    got = md.boost_with_patience(train, valid, ["a", "b"], max_iter=30, patience=3, step=0.5, maxDepth=3)
    curve = got.curve.orderBy("iter").collect()
    best = min(range(len(curve)), key=lambda i: (curve[i].test, i))
    assert got.best_iter == best and len(curve) == min(30, best + 4)
    assert got.model.getNumTrees == best + 1 and [r.passed for r in curve] == sorted(r.passed for r in curve)
    # the model is its first trees: its loss on the held-out rows is the curve's at the best iteration
    p = np.array([(r.y, r.score) for r in md.predict_proba(got.model, valid, ["a", "b"]).collect()])
    loss = -2 * np.log(np.where(p[:, 0] == 1, p[:, 1], 1 - p[:, 1])).mean()
    assert loss == pytest.approx(curve[best].test, rel=1e-9)
    margin = sum(w * t.predict(_vec(rows[1])) for w, t in zip(got.model.treeWeights, got.model.trees))
    one = md.predict_proba(got.model, df.where("row_id = 1"), ["a", "b"]).first().score
    assert one == pytest.approx(1 / (1 + np.exp(-2 * margin)), rel=1e-9)


def _vec(row):
    from pyspark.ml.linalg import Vectors
    return Vectors.dense(row[2:])


def test_a_search_resumes_after_a_stop(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 2, float(i % 7 + 3 * (i % 2))) for i in range(80)], "row_id long, y int, a double")
    space = {"C": ("loguniform", 0.01, 10.0)}
    fits = []

    def fit(d, p, stop_at=None):
        if stop_at is not None and len(fits) == stop_at:
            raise KeyboardInterrupt
        fits.append(p["C"])
        return md.fit_logistic(d, ["a"], C=p["C"], max_iter=20)
    state = str(tmp_path / "state")
    with pytest.raises(KeyboardInterrupt):
        md.random_search(df, df, ["a"], lambda d, p: fit(d, p, 2), space, 4, state=state)
    trials, best, model = md.random_search(df, df, ["a"], fit, space, 4, state=state)
    whole, want, _ = md.random_search(df, df, ["a"], fit, space, 4)
    assert len(set(fits[:4])) == 4 and best == want and model is not None
    assert sorted(map(str, trials.collect())) == sorted(map(str, whole.collect()))


def test_large_partitions_are_dealt_before_trees_are_fitted(frame, monkeypatch):
    """rows of a partition of any size go to tasks of bounded size."""
    one = frame.coalesce(1)
    assert md._fit_rows(one, X, ["y"]).rdd.getNumPartitions() == 1
    monkeypatch.setattr(md, "MOST_ROWS", 100)
    monkeypatch.setattr(md, "TASK_ROWS", 50)
    dealt = md._fit_rows(one, X, ["y"])
    assert dealt.rdd.glom().map(len).collect() and max(dealt.rdd.glom().map(len).collect()) <= 60
    assert sorted(map(str, dealt.collect())) == sorted(map(str, md.assemble(one, X).select("features", "y").collect()))


def _reads(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def test_test_rows_are_read_once_for_all_models(spark, frame, tmp_path):
    """one pass over the test rows, whatever the number of models."""
    frame.write.parquet(str(tmp_path / "t"))
    test = spark.read.parquet(str(tmp_path / "t"))
    avg, _ = md.seed_average(frame, test, X, boosted, [1, 2, 3])
    assert _reads(avg) == 1
    by_hand = [{r.row_id: r.score for r in md.predict_proba(boosted(frame, s), test, X).collect()} for s in (1, 2, 3)]
    for r in avg.collect():
        assert abs(r.score - sum(m[r.row_id] for m in by_hand) / 3) < 1e-12
    _, scored = md.oof_scores(frame, X, boosted, 4, test=test)
    assert _reads(scored) == 1 and scored.count() == 400


def test_ablation_writes_a_frame_once(frame):
    """feature sets over one frame read the same written rows."""
    sets = {"A": ["a"], "B": X}
    out = md.ablation({k: frame for k in sets}, lambda d, f: md.fit_logistic(d, f), sets)
    folders = {f.rsplit("/", 1)[0] for f in out.inputFiles()}
    assert len(folders) == 1 and "ablation-rows" in folders.pop()
