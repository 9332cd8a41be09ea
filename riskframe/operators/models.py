"""Models as distributed Spark ML jobs: M1-M9 and S6.

``pyspark.ml`` stands in for the single-machine learners: L2 logistic
regression, random forest and gradient-boosted trees.  Scores leave every
model as the long table ``(row_id, model, y, score)`` used by the metric
and ensemble operators.  Driver loops run over folds, seeds and parameter
draws (a handful of fits), never over rows.
"""

from __future__ import annotations

import math
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.ml import Model
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.operators.metrics import ranking_metrics
from riskframe.operators.quantiles import local_frame
from riskframe.operators.stats import score_spread
from riskframe.session import materialise


def assemble(df: DataFrame, features: list[str], out: str = "features") -> DataFrame:
    """P5: features -> one vector column (no physical split of the label)."""
    return VectorAssembler(inputCols=features, outputCol=out, handleInvalid="keep").transform(df)


#: Rows that a task of a tree fit is dealt, about, and the most that it takes as they come.
TASK_ROWS, MOST_ROWS = 1 << 18, 1 << 21


def _fit_rows(df: DataFrame, features: list[str], others: list[str]) -> DataFrame:
    """``(features, others...)`` of a tree fit.  Trees keep every partition's
    rows in memory, and columns that compress well put many rows into a
    partition of a file; rows of too large ones are assembled and dealt anew."""
    others = list(dict.fromkeys(others))
    rows = assemble(df.select(*dict.fromkeys([*features, *others])), features).select("features", *others)
    sizes = df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("n"))
    size = sizes.first()
    return rows.repartition(-(-size.n // TASK_ROWS)) if (size.most or 0) > MOST_ROWS else rows


def fit_logistic(df: DataFrame, features: list[str], label: str = "y", weight: str | None = None,
                 C: float = 0.01, max_iter: int = 1000) -> Model:
    """M1: L2 logistic regression with the ``C`` convention
    (``0.5 |w|^2 + C sum w_i loss_i``) mapped to Spark's averaged loss:
    ``regParam = 1 / (C * sum(w))``, no standardisation."""
    tot = df.agg(F.sum(F.col(weight)) if weight else F.count(F.lit(1))).first()[0]
    lr = LogisticRegression(featuresCol="features", labelCol=label, maxIter=max_iter,
                            regParam=1.0 / (C * float(tot)), elasticNetParam=0.0, standardization=False)
    if weight:
        lr = lr.setWeightCol(weight)
    return lr.fit(assemble(df, features))


def fit_forest(df: DataFrame, features: list[str], label: str = "y", weight: str | None = None,
               n_trees: int = 500, max_depth: int = 30, seed: int = 42, **params) -> Model:
    """M2: random forest; Spark's trees reach depth 30 at most."""
    if max_depth > 30:
        raise ValueError(f"max_depth {max_depth} is above Spark's limit of 30")
    rf = RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=n_trees,
                                maxDepth=max_depth, seed=seed, **params)
    if weight:
        rf = rf.setWeightCol(weight)
    return rf.fit(assemble(df, features))


def fit_boosted(df: DataFrame, features: list[str], label: str = "y", weight: str | None = None,
                valid_col: str | None = None, seed: int = 42, **params) -> Model:
    """M3: gradient-boosted trees; ``valid_col`` marks early-stopping rows
    (Spark stops on a relative tolerance, ``validationTol``; a patience count
    is ``boost_with_patience``)."""
    gbt = GBTClassifier(featuresCol="features", labelCol=label, seed=seed, **params)
    if weight:
        gbt = gbt.setWeightCol(weight)
    if valid_col:
        gbt = gbt.setValidationIndicatorCol(valid_col)
    return gbt.fit(_fit_rows(df, features, [c for c in (label, weight, valid_col) if c]))


@dataclass(frozen=True)
class Boosted:
    """A boosted model cut at its best iteration, and how it got there."""
    model: Model
    curve: DataFrame        # (iter, learn, test, passed, remaining), times in milliseconds
    best_iter: int


def boost_with_patience(train: DataFrame, valid: DataFrame, features: list[str], label: str = "y", weight: str | None = None,
                        max_iter: int = 1000, patience: int = 50, step: float = 0.1, seed: int = 42, **params) -> Boosted:
    """M3 with a patience count: trees are added one at a time, each fitted
    to the log-loss residuals of the margin so far; after each the loss of
    ``valid`` is measured, and fitting stops once ``patience`` trees in a row
    brought no new best.  The model holds the trees up to the first best one
    (tree weights: 1, then ``step``).

    The margins of both frames are one table that is rewritten once a tree,
    so an iteration reads its predecessor only.  ``params`` go to Spark's
    ``DecisionTreeRegressor``."""
    spark = train.sparkSession
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    side = lambda d, v, wt: assemble(d, features).select(
        "features", (2.0 * F.col(label) - 1.0).alias("y"), wt.alias("w"), F.lit(v).alias("v"), F.lit(0.0).alias("m"))
    rows = materialise(side(train, False, w).unionByName(side(valid, True, F.lit(1.0))), "boost-margins")
    loss = F.lit(2.0) * (F.greatest(-2 * F.col("y") * F.col("m"), F.lit(0.0)) + F.log1p(F.exp(-F.abs(2 * F.col("y") * F.col("m")))))
    trees, curve, best, began = [], [], (None, float("inf")), time.monotonic()
    for i in range(max_iter):
        target = F.col("y") if i == 0 else 4.0 * F.col("y") / (1.0 + F.exp(2.0 * F.col("y") * F.col("m")))
        tree = DecisionTreeRegressor(featuresCol="features", labelCol="r", weightCol="w", predictionCol="p", seed=seed + i,
                                     **params).fit(rows.where("not v").withColumn("r", target))
        trees.append(tree)
        share = 1.0 if i == 0 else step
        rows = materialise(tree.transform(rows).withColumn("m", F.col("m") + F.lit(share) * F.col("p")).drop("p"), "boost-margins")
        at = {r.v: r.l for r in rows.groupBy("v").agg((F.sum(loss * F.col("w")) / F.sum("w")).alias("l")).collect()}
        passed = (time.monotonic() - began) * 1000
        curve.append((i, at.get(False), at.get(True), int(passed), int(passed / (i + 1) * (max_iter - i - 1))))
        if at.get(True) is not None and at[True] < best[1]:
            best = (i, at[True])
        if best[0] is not None and i - best[0] >= patience:
            break
    n = len(trees) if best[0] is None else best[0] + 1
    jvm, gw = spark._jvm, spark.sparkContext._gateway
    held = gw.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, n)
    shares = gw.new_array(jvm.double, n)
    for i in range(n):
        held[i], shares[i] = trees[i]._java_obj, 1.0 if i == 0 else step
    java = jvm.org.apache.spark.ml.classification.GBTClassificationModel(f"gbt-{uuid.uuid4().hex[:12]}", held, shares, len(features), 2)
    fields = [("iter", "bigint"), ("learn", "double"), ("test", "double"), ("passed", "bigint"), ("remaining", "bigint")]
    return Boosted(GBTClassificationModel(java), local_frame(spark, curve, fields), n - 1)


def predict_proba(model: Model, df: DataFrame, features: list[str], name: str = "score",
                  keep: list[str] | None = None) -> DataFrame:
    """M4: positive-class probability."""
    keep = keep or ["row_id", "y"]
    out = model.transform(assemble(df, features))
    return out.select(*keep, vector_to_array("probability")[1].alias(name))


def _predict_each(models: list[Model], names: list[str], df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """``(keep..., model, score)``: positive-class probabilities by every
    model, from one pass over ``df``."""
    out = assemble(df.select(*dict.fromkeys([*keep, *features])), features)
    for i, m in enumerate(models):
        out = m.copy({m.rawPredictionCol: f"_raw{i}", m.probabilityCol: f"_prob{i}", m.predictionCol: f"_pred{i}"}).transform(out)
    rows = F.array(*[F.struct(F.lit(n).alias("model"), vector_to_array(f"_prob{i}")[1].alias("score"))
                     for i, n in enumerate(names)])
    return out.select(*keep, F.inline(rows))


FitFn = Callable[[DataFrame], Model]


def oof_scores(df: DataFrame, features: list[str], fit: FitFn, k: int = 5, fold: str = "fold",
               test: DataFrame | None = None, model_name: str = "model",
               label: str = "y") -> tuple[DataFrame, DataFrame | None]:
    """M5: out-of-fold scores (each row scored by the model that did not
    see it) and, when ``test`` is given, the mean of the k fold models'
    test scores.  Returns long ``(row_id, model, y, score)`` frames."""
    oof, tests, models = None, None, []
    for f in range(k):
        m = fit(df.where(F.col(fold) != f))
        part = predict_proba(m, df.where(F.col(fold) == f), features, keep=["row_id", label])
        oof = part if oof is None else oof.unionByName(part)
        models.append(m)
    oof = oof.select("row_id", F.lit(model_name).alias("model"), F.col(label).alias("y"), "score")
    if test is not None:
        tests = _predict_each(models, [str(f) for f in range(k)], test, features, ["row_id", label])
        tests = (tests.groupBy("row_id").agg(F.first(label).alias("y"), F.avg("score").alias("score"))
                 .select("row_id", F.lit(model_name).alias("model"), "y", "score"))
    return oof, tests


def seed_average(train: DataFrame, test: DataFrame, features: list[str], fit_seeded: Callable[[DataFrame, int], Model],
                 seeds: list[int], model_name: str = "seed_avg",
                 label: str = "y") -> tuple[DataFrame, DataFrame]:
    """M6: models differing only in seed; test scores averaged per row and
    the spread of their AUCs (min, max, population std).  ``test`` is read
    once for all models."""
    models = [fit_seeded(train, s) for s in seeds]
    per = _predict_each(models, [f"seed_{s}" for s in seeds], test, features, ["row_id", label]).withColumnRenamed(label, "y")
    aucs = ranking_metrics(per, ["model"])
    by_seed = aucs.agg(F.map_from_entries(F.collect_list(F.struct("model", "roc_auc"))).alias("auc_by_seed"))
    spread = score_spread(aucs, "roc_auc").select("*", by_seed.select("auc_by_seed").scalar().alias("auc_by_seed"))
    avg = (per.groupBy("row_id").agg(F.first("y").alias("y"), F.avg("score").alias("score"))
           .select("row_id", F.lit(model_name).alias("model"), "y", "score"))
    return avg, spread


def sample_params(space: dict, n: int, seed: int = 42) -> list[dict]:
    """M7 draws: ``space`` maps a parameter to ``("loguniform", lo, hi)``,
    ``("uniform", lo, hi)``, ``("int", lo, hi)`` or ``("choice", [..])``; a
    callable value ``f(params) -> spec or None`` makes it conditional."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        p: dict = {}
        for name, spec in space.items():
            if callable(spec):
                spec = spec(p)
                if spec is None:
                    continue
            kind = spec[0]
            if kind == "loguniform":
                p[name] = float(math.exp(rng.uniform(math.log(spec[1]), math.log(spec[2]))))
            elif kind == "uniform":
                p[name] = float(rng.uniform(spec[1], spec[2]))
            elif kind == "int":
                p[name] = int(rng.integers(spec[1], spec[2] + 1))
            elif kind == "choice":
                p[name] = spec[1][int(rng.integers(0, len(spec[1])))]
            else:
                raise ValueError(kind)
        out.append(p)
    return out


def random_search(train: DataFrame, valid: DataFrame, features: list[str],
                  fit_params: Callable[[DataFrame, dict], Model], space: dict, n: int,
                  seed: int = 42, label: str = "y", state: str | None = None,
                  run_id: str = "search") -> tuple[DataFrame, dict, Model]:
    """M7: best of ``n`` seeded draws by validation ROC-AUC.

    Returns ``(trials, best_params, best_model)``; ``trials`` is a frame
    ``(trial, params, roc_auc)``.  With ``state``, a stage-state path (S10),
    every finished draw is appended there, and a search that starts again
    under the same ``run_id`` skips the draws it finds; if the best one is
    among them, its model is fitted anew (draws are seeded)."""
    from riskframe.sources.logs import load_stage_state, save_stage_state
    spark = train.sparkSession
    done = {}
    if state:
        done = {r.stage: r.kv for r in load_stage_state(spark, state, run_id).collect()}
    rows, best = [], (None, -1.0, None)
    for i, p in enumerate(sample_params(space, n, seed)):
        text = {k: str(v) for k, v in p.items()}
        found, m = done.get(f"trial-{i}"), None
        if found is not None and {k: v for k, v in found.items() if k != "roc_auc"} == text:
            auc = None if found["roc_auc"] == "None" else float(found["roc_auc"])
        else:
            m = fit_params(train, p)
            sc = predict_proba(m, valid, features, keep=["row_id", label]).withColumnRenamed(label, "y")
            auc = ranking_metrics(sc.withColumn("model", F.lit("m")), ["model"]).first()["roc_auc"]
            if state:
                save_stage_state(spark, state, run_id, f"trial-{i}", {**text, "roc_auc": repr(auc)})
        rows.append((i, text, float(auc) if auc is not None else None))
        if auc is not None and auc > best[1]:
            best = (p, auc, m)
    model = fit_params(train, best[0]) if best[0] is not None and best[2] is None else best[2]
    trials = spark.createDataFrame(rows, "trial int, params map<string,string>, roc_auc double")
    return trials, best[0], model


def feature_importance(model: Model, features: list[str]) -> DataFrame:
    """``(feature, importance)`` largest first (tie: name)."""
    from pyspark.sql import SparkSession
    ss = SparkSession.getActiveSession()
    imp = model.featureImportances.toArray().tolist()
    df = ss.createDataFrame(list(zip(features, [float(v) for v in imp])), "feature string, importance double")
    return df.orderBy(F.col("importance").desc(), F.col("feature"))


def ablation(frames: dict[str, DataFrame], fit: Callable[[DataFrame, list[str]], Model],
             feature_sets: dict[str, list[str]], valid_fold: int = 0, fold: str = "fold",
             label: str = "y") -> DataFrame:
    """M9: the same model family on feature sets A / B / C; one long score
    table ``(row_id, model=<set>, y, score)`` for side-by-side metrics.
    A frame is written once, however many sets it serves."""
    out, held = None, {}
    for name, feats in feature_sets.items():
        df = frames[name]
        if id(df) not in held:
            held[id(df)] = materialise(df, "ablation-rows")
        df = held[id(df)]
        m = fit(df.where(F.col(fold) != valid_fold), feats)
        sc = (predict_proba(m, df.where(F.col(fold) == valid_fold), feats, keep=["row_id", label])
              .select("row_id", F.lit(name).alias("model"), F.col(label).alias("y"), "score"))
        out = sc if out is None else out.unionByName(sc)
    return out
