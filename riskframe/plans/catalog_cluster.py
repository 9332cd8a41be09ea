"""Registered queries: density clustering and cluster quality (C1-C4,
A25, A26, A16 on DBSCAN output).

Points: per customer of ``orders``, ``(avg(o_totalprice), count(*))``
robust-scaled (median / IQR), eps 0.2, min_samples 3.  Quality indices
also run on ``embeddings`` with its given ``label``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.operators import cluster as cl
from riskframe.operators import stats as st
from riskframe.plans.catalog_stats import _fences_cte
from riskframe.plans.common import round_doubles, table
from riskframe.plans.registry import register

EPS, MIN_SAMPLES = 0.2, 3


def customer_points(spark, sf):
    o = table(spark, sf, "orders")
    agg = o.groupBy("o_custkey").agg(F.avg("o_totalprice").alias("avg_price"),
                                     F.count(F.lit(1)).cast("double").alias("n_orders"))
    cols = ["avg_price", "n_orders"]
    scaled = st.apply_robust_scaler(agg, st.fit_robust_scaler(agg, cols), cols)
    return cl.as_points(scaled, "o_custkey", cols)


PTS_SQL = """a AS (SELECT o_custkey AS id, avg(o_totalprice) AS p, count(*)::DOUBLE AS n FROM orders GROUP BY o_custkey),
  sc AS (SELECT quantile_cont(p, 0.5) AS pm, quantile_cont(p, 0.75) - quantile_cont(p, 0.25) AS pi,
                quantile_cont(n, 0.5) AS nm, quantile_cont(n, 0.75) - quantile_cont(n, 0.25) AS ni FROM a),
  pts AS (SELECT id, (p - pm) / CASE WHEN pi = 0 THEN 1.0 ELSE pi END AS x0,
                 (n - nm) / CASE WHEN ni = 0 THEN 1.0 ELSE ni END AS x1 FROM a, sc),
  nb AS (SELECT a.id AS a, b.id AS b FROM pts a JOIN pts b
         ON sqrt((a.x0 - b.x0) * (a.x0 - b.x0) + (a.x1 - b.x1) * (a.x1 - b.x1)) <= 0.2)"""

DBSCAN_SQL = f"""WITH RECURSIVE {PTS_SQL},
  core AS (SELECT a AS id FROM nb GROUP BY a HAVING count(*) >= 3),
  ce AS (SELECT nb.a, nb.b FROM nb JOIN core c1 ON nb.a = c1.id JOIN core c2 ON nb.b = c2.id),
  reach(src, dst) AS (SELECT id, id FROM core UNION SELECT r.src, ce.b FROM reach r JOIN ce ON r.dst = ce.a),
  comp AS (SELECT dst AS id, min(src) AS lab FROM reach GROUP BY dst),
  border AS (SELECT nb.a AS id, min(comp.lab) AS lab FROM nb JOIN comp ON nb.b = comp.id
             WHERE nb.a NOT IN (SELECT id FROM core) GROUP BY nb.a),
  lab AS (SELECT id, lab FROM comp UNION ALL SELECT id, lab FROM border),
  ren AS (SELECT lab, CAST(dense_rank() OVER (ORDER BY lab) - 1 AS INTEGER) AS cluster FROM (SELECT DISTINCT lab FROM comp)),
  res AS (SELECT pts.id, coalesce(ren.cluster, -1) AS cluster FROM pts LEFT JOIN lab ON pts.id = lab.id
          LEFT JOIN ren ON lab.lab = ren.lab)"""


@register("c3_neighbour_pairs_orders",
          f"WITH {PTS_SQL} SELECT a.id AS id_a, b.id AS id_b, "
          "round(sqrt((a.x0 - b.x0) * (a.x0 - b.x0) + (a.x1 - b.x1) * (a.x1 - b.x1)), 6) AS dist "
          "FROM pts a JOIN pts b ON a.id < b.id AND "
          "sqrt((a.x0 - b.x0) * (a.x0 - b.x0) + (a.x1 - b.x1) * (a.x1 - b.x1)) <= 0.2")
def c3_neighbour_pairs_orders(spark, sf):
    return round_doubles(cl.neighbour_pairs(customer_points(spark, sf), EPS))


@register("c2_dbscan_orders", DBSCAN_SQL + " SELECT id, cluster FROM res")
def c2_dbscan_orders(spark, sf):
    return cl.dbscan(customer_points(spark, sf), EPS, MIN_SAMPLES)


@register("a16_cluster_summary_dbscan_orders",
          DBSCAN_SQL + " SELECT count(DISTINCT CASE WHEN cluster <> -1 THEN cluster END) AS n_clusters, "
          "CAST(count(*) FILTER (WHERE cluster = -1) AS BIGINT) AS n_noise, "
          "round(count(*) FILTER (WHERE cluster = -1) * 100.0 / count(*), 6) AS noise_pct, count(*) AS n_rows FROM res")
def a16_cluster_summary_dbscan_orders(spark, sf):
    labels = cl.dbscan(customer_points(spark, sf), EPS, MIN_SAMPLES)
    return round_doubles(st.cluster_summary(labels, "cluster"))


EMB_SQL = "e AS (SELECT vec_id AS id, label, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings)"


def emb_points(spark, sf):
    em = table(spark, sf, "embeddings")
    return cl.as_points(em, "vec_id", array_col="embedding"), em.select(F.col("vec_id").alias("id"), F.col("label").alias("cluster"))


def folded_points(spark, sf):
    """``embeddings`` in 7 dimensions: every coordinate added to that of its
    position modulo 7."""
    v = F.transform(F.col("embedding"), lambda c: c.cast("double"))
    at = lambda k: lambda c, i: F.pmod(i, F.lit(7)) == k
    sums = [F.aggregate(F.filter(v, at(k)), F.lit(0.0), lambda a, c: a + c) for k in range(7)]
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.array(*sums).alias("x"))


_FOLDED_SQL = "pts AS (SELECT vec_id AS id, " + ", ".join(
    f"list_sum([embedding[i]::DOUBLE FOR i IN range({k + 1}, len(embedding) + 1, 7)]) AS x{k}" for k in range(7)) + " FROM embeddings)"
_DIST7 = "sqrt(" + " + ".join(f"(a.x{k} - b.x{k}) * (a.x{k} - b.x{k})" for k in range(7)) + ")"
DBSCAN7_SQL = (f"WITH RECURSIVE {_FOLDED_SQL}, nb AS (SELECT a.id AS a, b.id AS b FROM pts a JOIN pts b ON {_DIST7} <= 0.45),\n"
               + DBSCAN_SQL[DBSCAN_SQL.index("  core AS"):])


@register("c2_dbscan_7d_embeddings", DBSCAN7_SQL + " SELECT id, cluster FROM res")
def c2_dbscan_7d_embeddings(spark, sf):
    return cl.dbscan(folded_points(spark, sf), 0.45, MIN_SAMPLES)


@register("c3_neighbour_pairs_7d_embeddings",
          f"WITH {_FOLDED_SQL} SELECT a.id AS id_a, b.id AS id_b, round({_DIST7}, 6) AS dist "
          f"FROM pts a JOIN pts b ON a.id < b.id AND {_DIST7} <= 0.45")
def c3_neighbour_pairs_7d_embeddings(spark, sf):
    return round_doubles(cl.neighbour_pairs(folded_points(spark, sf), 0.45))


@register("a25_silhouette_embeddings",
          f"""WITH {EMB_SQL},
              d AS (SELECT a.id, a.label AS la, b.label AS lb, list_distance(a.x, b.x) AS dist FROM e a JOIN e b ON a.id <> b.id),
              m AS (SELECT id, la, lb, avg(dist) AS md FROM d GROUP BY id, la, lb),
              sz AS (SELECT label, count(*) AS n FROM e GROUP BY label),
              ab AS (SELECT e.id, e.label, max(CASE WHEN m.lb = e.label THEN m.md END) AS a,
                            min(CASE WHEN m.lb <> e.label THEN m.md END) AS b FROM e JOIN m ON e.id = m.id GROUP BY e.id, e.label),
              s AS (SELECT ab.id, CASE WHEN sz.n <= 1 THEN 0.0 ELSE (b - a) / greatest(a, b) END AS s
                    FROM ab JOIN sz ON ab.label = sz.label)
              SELECT round(avg(s), 6) AS silhouette, count(*) AS n_sample, (SELECT count(*) FROM sz) AS n_clusters FROM s""")
def a25_silhouette_embeddings(spark, sf):
    pts, labels = emb_points(spark, sf)
    return round_doubles(cl.silhouette(pts, labels))


@register("a25_silhouette_squared_embeddings",
          f"""WITH {EMB_SQL},
              d AS (SELECT a.id, a.label AS la, b.label AS lb, pow(list_distance(a.x, b.x), 2) AS dist FROM e a JOIN e b ON a.id <> b.id),
              m AS (SELECT id, la, lb, avg(dist) AS md FROM d GROUP BY id, la, lb),
              ab AS (SELECT id, max(CASE WHEN la = lb THEN md END) AS a, min(CASE WHEN la <> lb THEN md END) AS b FROM m GROUP BY id)
              SELECT round(avg(CASE WHEN a IS NULL THEN 0.0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette, count(*) AS n_sample,
                     (SELECT count(DISTINCT label) FROM e) AS n_clusters FROM ab""")
def a25_silhouette_squared_embeddings(spark, sf):
    pts, labels = emb_points(spark, sf)
    return round_doubles(cl.silhouette_squared(pts, labels))


_X7 = [f"x{k}" for k in range(7)]
_INSIDE7 = " AND ".join(f"NOT ({c} < f.{c}_lo OR {c} > f.{c}_hi)" for c in _X7)
_SQ7 = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in _X7)
_CAPPED7 = ", ".join(f"least(greatest({c}, f.{c}_lo), f.{c}_hi) AS {c}" for c in _X7)


def _squared_sql(rows: str) -> str:
    """The silhouette over squared distances of ``rows(id, label, x0..x6)``."""
    return f"""SELECT avg(CASE WHEN a IS NULL THEN 0.0 ELSE (b - a) / greatest(a, b) END) FROM (
        SELECT id, max(CASE WHEN la = lb THEN md END) AS a, min(CASE WHEN la <> lb THEN md END) AS b FROM (
          SELECT a.id, a.label AS la, b.label AS lb, avg({_SQ7}) AS md FROM {rows} a JOIN {rows} b ON a.id <> b.id
          GROUP BY a.id, a.label, b.label) GROUP BY id)"""


@register("a8_coverage_compare_scores_embeddings",
          f"""WITH {_FOLDED_SQL}, {_fences_cte('pts', _X7)}, l AS (SELECT vec_id AS id, label FROM embeddings),
              inside AS (SELECT pts.*, label FROM pts JOIN l USING (id), f WHERE {_INSIDE7}),
              capped AS (SELECT id, label, {_CAPPED7} FROM pts JOIN l USING (id), f),
              s AS (SELECT (SELECT count(*) FROM pts) AS n, (SELECT count(*) FROM inside) AS k,
                           ({_squared_sql('inside')}) AS sd, ({_squared_sql('capped')}) AS sc)
              SELECT 'drop' AS approach, k AS rows_used, n AS total_rows, round(k * 100.0 / n, 6) AS coverage_pct,
                     round(sd, 6) AS score, NULL::DOUBLE AS delta_pct FROM s
              UNION ALL SELECT 'cap', n, n, 100.0, round(sc, 6), round((sc - sd) * 100.0 / sd, 6) FROM s""")
def a8_coverage_compare_scores_embeddings(spark, sf):
    """Dropping against capping outliers, each scored by the silhouette of
    the given labels on the rows that it leaves."""
    x = folded_points(spark, sf).select("id", *[F.col("x")[k].alias(c) for k, c in enumerate(_X7)])
    labels = emb_points(spark, sf)[1]
    score = lambda d: cl.silhouette_squared(cl.as_points(d, "id", _X7), labels).first().silhouette
    scores = score(st.iqr_drop(x, _X7)), score(st.iqr_cap(x, _X7)[0])
    return round_doubles(st.coverage_compare(x, _X7, score_drop=scores[0], score_cap=scores[1]))


@register("a26_davies_bouldin_embeddings",
          f"""WITH {EMB_SQL},
              u AS (SELECT e.label, i, v FROM e, unnest(x) WITH ORDINALITY AS t(v, i)),
              c AS (SELECT label, list(cv ORDER BY i) AS c FROM (SELECT label, i, avg(v) AS cv FROM u GROUP BY label, i) GROUP BY label),
              sp AS (SELECT e.label, avg(list_distance(e.x, c.c)) AS s FROM e JOIN c ON e.label = c.label GROUP BY e.label),
              cs AS (SELECT c.label, c.c, sp.s FROM c JOIN sp ON c.label = sp.label),
              r AS (SELECT a.label, max((a.s + b.s) / list_distance(a.c, b.c)) AS r FROM cs a JOIN cs b ON a.label <> b.label
                    GROUP BY a.label)
              SELECT round(avg(r), 6) AS davies_bouldin, count(*) AS n_clusters FROM r""")
def a26_davies_bouldin_embeddings(spark, sf):
    pts, labels = emb_points(spark, sf)
    return round_doubles(cl.davies_bouldin(pts, labels))


@register("c1_c4_segment_customers")
def c1_c4_segment_customers(spark, sf):
    """The segmentation composition on per-customer order aggregates."""
    from riskframe.plans.segment import segment
    o = table(spark, sf, "orders")
    cust = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    agg = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.sum("o_totalprice").alias("purchases"), F.max("o_totalprice").alias("oneoff"),
        F.count(F.lit(1)).cast("double").alias("n_orders"), F.avg("o_totalprice").alias("avg_order"))
    df = cust.join(agg, "c_custkey", "left")
    res = segment(df, "c_custkey", impute=["purchases", "oneoff", "n_orders", "avg_order"],
                  cap=["purchases", "oneoff", "avg_order", "c_acctbal"], skewed=["purchases", "oneoff", "avg_order"],
                  ratios={"purchase_to_order": ("purchases", "n_orders"), "oneoff_share": ("oneoff", "purchases")},
                  drop=["avg_order"], profile_cols=["purchases", "oneoff", "n_orders", "c_acctbal"],
                  n_components=2, eps=0.3, min_samples=3)
    return round_doubles(res.summary)


@register("f2_drop_noise_dbscan_orders", DBSCAN_SQL + " SELECT id, cluster FROM res WHERE cluster <> -1")
def f2_drop_noise_dbscan_orders(spark, sf):
    return st.drop_noise(cl.dbscan(customer_points(spark, sf), EPS, MIN_SAMPLES), "cluster")
