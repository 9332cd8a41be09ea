"""Registered queries: models, resampling and the fraud composition
(M1-M9, S6, R1, R2).

Model fits have no SQL twin (rows-only check).  Tomek-link detection is exact and checked
against a DuckDB mutual-nearest-neighbour query.

Fixture: ``lineitem`` with ``y = (l_quantity * l_discount >= 3)`` (a rare
class), features ``l_quantity, l_extendedprice, l_discount, l_tax``;
train = shipped before 2000, test = the rest.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.operators import metrics as mt
from riskframe.operators import models as md
from riskframe.operators import rank as rk
from riskframe.operators import resample as rs
from riskframe.operators import stats as st
from riskframe.operators.quantiles import quantiles
from riskframe.plans.common import LINEITEM_V, lineitem, round_doubles, table
from riskframe.plans.fraud import fraud_scoring
from riskframe.plans.registry import register
from riskframe.session import materialise

SPLIT = "2000-01-01"
GBT = {"maxIter": 5, "maxDepth": 3, "stepSize": 0.3}


def labelled(spark, sf):
    li = lineitem(spark, sf)
    y = ((F.col("l_quantity") * F.col("l_discount")) >= 3.0).cast("int")
    return li.select("row_id", y.alias("y"), *LINEITEM_V, "l_shipdate")


def split(spark, sf):
    d = labelled(spark, sf)
    cut = F.lit(SPLIT).cast("timestamp_ntz")
    return (d.where(F.col("l_shipdate") < cut).drop("l_shipdate"),
            d.where(F.col("l_shipdate") >= cut).drop("l_shipdate"))


def _eval(scores, name):
    return round_doubles(mt.evaluate(scores.withColumn("model", F.lit(name)), 0.5, notes=name,
                                     with_timestamp=False))


@register("m1_logistic_lineitem")
def m1_logistic_lineitem(spark, sf):
    train, test = split(spark, sf)
    train = st.with_balanced_weight(train, "y", "w")
    m = md.fit_logistic(train, LINEITEM_V, weight="w", C=0.01, max_iter=100)
    return _eval(md.predict_proba(m, test, LINEITEM_V), "logistic")


@register("m2_forest_lineitem")
def m2_forest_lineitem(spark, sf):
    train, test = split(spark, sf)
    train = st.with_balanced_weight(train, "y", "w")
    m = md.fit_forest(train, LINEITEM_V, weight="w", n_trees=20, max_depth=6)
    return _eval(md.predict_proba(m, test, LINEITEM_V), "forest")


@register("m3_boosted_lineitem")
def m3_boosted_lineitem(spark, sf):
    train, test = split(spark, sf)
    train = rk.stratified_folds(st.with_class_weight(train, "y", "w"), "y", 5, 42)
    # written once: the fit reads its training and its validation rows apart
    train = materialise(train.select("y", "w", (F.col("fold") == 0).alias("is_valid"), *LINEITEM_V), "boost-train")
    m = md.fit_boosted(train, LINEITEM_V, weight="w", valid_col="is_valid", **GBT)
    return _eval(md.predict_proba(m, test, LINEITEM_V), "boosted")


@register("m4_predict_proba_lineitem")
def m4_predict_proba_lineitem(spark, sf):
    train, test = split(spark, sf)
    m = md.fit_logistic(train, LINEITEM_V, C=1.0, max_iter=50)
    return md.predict_proba(m, test, LINEITEM_V)


@register("m5_oof_scores_lineitem")
def m5_oof_scores_lineitem(spark, sf):
    train, _ = split(spark, sf)
    train = rk.stratified_folds(train, "y", 3, 42)
    oof, _ = md.oof_scores(train, LINEITEM_V, lambda d: md.fit_logistic(d, LINEITEM_V, C=1.0, max_iter=50),
                           3, model_name="logistic")
    return oof


@register("m6_seed_average_lineitem")
def m6_seed_average_lineitem(spark, sf):
    train, test = split(spark, sf)
    fit = lambda d, s: md.fit_boosted(d, LINEITEM_V, seed=s, subsamplingRate=0.7, **GBT)
    _, spread = md.seed_average(train, test, LINEITEM_V, fit, [1, 2, 3])
    return round_doubles(spread)


@register("m7_random_search_lineitem")
def m7_random_search_lineitem(spark, sf):
    train, test = split(spark, sf)
    space = {"maxDepth": ("int", 2, 4), "stepSize": ("loguniform", 0.05, 0.5),
             "subsamplingRate": ("uniform", 0.6, 1.0),
             "minInstancesPerNode": lambda p: ("int", 1, 20) if p["maxDepth"] > 2 else None}
    fit = lambda d, p: md.fit_boosted(d, LINEITEM_V, maxIter=4, **p)
    trials, _, _ = md.random_search(train, test, LINEITEM_V, fit, space, 3, seed=7)
    return round_doubles(trials)


@register("m8_s6_feature_importance_lineitem")
def m8_s6_feature_importance_lineitem(spark, sf):
    train, _ = split(spark, sf)
    m = md.fit_boosted(train, LINEITEM_V, **GBT)
    return round_doubles(md.feature_importance(m, LINEITEM_V))


@register("m9_ablation_lineitem")
def m9_ablation_lineitem(spark, sf):
    train, _ = split(spark, sf)
    train = rk.stratified_folds(train, "y", 3, 42)
    sets = {"A": ["l_quantity", "l_discount"], "B": LINEITEM_V, "C": ["l_extendedprice", "l_tax"]}
    fit = lambda d, feats: md.fit_logistic(d, feats, C=1.0, max_iter=50)
    scores = md.ablation({k: train for k in sets}, fit, sets)
    return round_doubles(mt.ranking_metrics(scores, ["model"]))


@register("fraud_scoring_events")
def fraud_scoring_events(spark, sf):
    """The rare-event composition on ``events``: y = value above its p99,
    Amount = value, Time = second of day, V = (user_id, props length)."""
    ev = table(spark, sf, "events")
    p99 = quantiles(ev, ["value"], [0.99]).first().q
    sec = (F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")).cast("double")
    base = ev.select(F.col("event_id").alias("row_id"), (F.col("value") > F.lit(p99)).cast("int").alias("y"),
                     F.col("value").alias("Amount"), sec.alias("Time"),
                     F.col("user_id").cast("double").alias("V1"), F.length("props").cast("double").alias("V2"),
                     "ts")
    cut = F.lit("2024-01-22").cast("timestamp_ntz")
    train = base.where(F.col("ts") < cut).drop("ts")
    test = base.where(F.col("ts") >= cut).drop("ts")
    results, _ = fraud_scoring(train, test, ["V1", "V2"], "Amount", "Time", k=3,
                               gbt_params={"maxIter": 5, "maxDepth": 3})
    return round_doubles(results.drop("timestamp"))


# ---- R1 / R2 ------------------------------------------------------------------------

@register("r1_smote_labels",
          "WITH d AS (SELECT toxic AS y, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY toxic) "
          "SELECT y, 0 AS synthetic, n FROM d UNION ALL "
          "SELECT 1, 1, (SELECT n FROM d WHERE y = 0) - (SELECT n FROM d WHERE y = 1)")
def r1_smote_labels(spark, sf):
    lab = table(spark, sf, "labels")
    docs = table(spark, sf, "documents").select("doc_id", "n_chars", F.length("text").alias("text_len"))
    d = lab.join(docs, "doc_id").select(F.col("doc_id").alias("row_id"), F.col("toxic").alias("y"),
                                        F.log1p("n_chars").alias("f1"), F.log1p("text_len").alias("f2"),
                                        F.col("quality").cast("double").alias("f3"))
    out = rs.smote(d, "y", "row_id", ["f1", "f2", "f3"], k=5, seed=42)
    return out.groupBy("y", "synthetic").agg(F.count(F.lit(1)).alias("n"))


TOMEK_SQL = """WITH e AS (SELECT vec_id AS id, CASE WHEN label < 5 THEN 1 ELSE 0 END AS y,
                          list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings),
  d AS (SELECT a.id AS a, b.id AS b, list_distance(a.x, b.x) AS dist FROM e a JOIN e b ON a.id <> b.id),
  nn AS (SELECT a, arg_min(b, (dist, b)) AS nb FROM d GROUP BY a),
  yy AS (SELECT nn.a, nn.nb, e1.y AS ya, e2.y AS yb FROM nn JOIN e e1 ON nn.a = e1.id JOIN e e2 ON nn.nb = e2.id)
  SELECT p.a AS id_a, p.nb AS id_b FROM yy p JOIN yy q ON p.nb = q.a AND q.nb = p.a
  WHERE p.ya <> p.yb AND p.a < p.nb"""


@register("r2_tomek_links_embeddings", TOMEK_SQL)
def r2_tomek_links_embeddings(spark, sf):
    em = table(spark, sf, "embeddings")
    d = em.select(F.col("vec_id").alias("row_id"), (F.col("label") < 5).cast("int").alias("y"),
                  *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)])
    return rs.tomek_links(d, "y", "row_id", [f"e{i}" for i in range(64)])


@register("r2_remove_tomek_embeddings",
          f"WITH links AS ({TOMEK_SQL}) SELECT vec_id AS row_id, CASE WHEN label < 5 THEN 1 ELSE 0 END AS y FROM embeddings "
          "WHERE vec_id NOT IN (SELECT id_a FROM links) AND vec_id NOT IN (SELECT id_b FROM links)")
def r2_remove_tomek_embeddings(spark, sf):
    em = table(spark, sf, "embeddings")
    d = em.select(F.col("vec_id").alias("row_id"), (F.col("label") < 5).cast("int").alias("y"),
                  *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)])
    return rs.remove_tomek(d, "y", "row_id", [f"e{i}" for i in range(64)]).select("row_id", "y")


_H = "('0x' || substr(md5('{}-' || {}), 1, 13))::BIGINT"


@register("r2_smote_tomek_labels",
          f"""WITH d AS (SELECT doc_id::VARCHAR AS id, toxic AS y, n_chars / 1000.0 AS a, quality * 0.5 AS b
                         FROM labels JOIN documents USING (doc_id)),
              m AS (SELECT * FROM d WHERE y = 1),
              c AS (SELECT (SELECT count(*) FROM d WHERE y = 0) - count(*) AS s, count(*) AS m FROM m),
              nn AS (SELECT id, list(nid ORDER BY dist, nid)[:5] AS nn
                     FROM (SELECT p.id, q.id AS nid, sqrt((p.a - q.a) * (p.a - q.a) + (p.b - q.b) * (p.b - q.b)) AS dist
                           FROM m p JOIN m q ON p.id <> q.id) GROUP BY id),
              r AS (SELECT *, row_number() OVER (ORDER BY {_H.format(42, "id")}, id) - 1 AS r FROM m),
              g AS (SELECT r.*, unnest(range(0, c.s // c.m + CASE WHEN r.r < c.s % c.m THEN 1 ELSE 0 END)) AS k FROM r, c),
              t AS (SELECT g.*, nn[1 + {_H.format(42, "id || '-' || k")} % len(nn)] AS nid,
                           {_H.format(43, "id || '-' || k")}::DOUBLE / 4503599627370496.0 AS u FROM g JOIN nn USING (id)),
              x AS (SELECT id, y, 0 AS synthetic, a, b FROM d UNION ALL
                    SELECT t.id || '#' || t.k, 1, 1, t.a + u * (m.a - t.a), t.b + u * (m.b - t.b) FROM t JOIN m ON t.nid = m.id),
              n1 AS (SELECT p.id, p.y, arg_min(q.id, (sqrt((p.a - q.a) * (p.a - q.a) + (p.b - q.b) * (p.b - q.b)), q.id)) AS nid
                     FROM x p JOIN x q ON p.id <> q.id GROUP BY p.id, p.y),
              gone AS (SELECT p.id FROM n1 p JOIN n1 q ON p.nid = q.id AND q.nid = p.id WHERE p.y <> q.y)
              SELECT y, synthetic, count(*) AS n FROM x WHERE id NOT IN (SELECT id FROM gone) GROUP BY y, synthetic""")
def r2_smote_tomek_labels(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    d = table(spark, sf, "labels").join(docs, "doc_id").select(
        F.col("doc_id").alias("row_id"), F.col("toxic").alias("y"), (F.col("n_chars") / 1000.0).alias("a"),
        (F.col("quality") * 0.5).alias("b"))
    out = rs.smote_tomek(d, "y", "row_id", ["a", "b"], k=5, seed=42)
    return out.groupBy("y", "synthetic").agg(F.count(F.lit(1)).alias("n"))
