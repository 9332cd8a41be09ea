"""Registered queries: ranking, threshold metrics, ensembles (W1-W5,
A17-A24, U1, J1, J2, E1-E7, F3, F4).

Score fixture: on the whole ``lineitem`` table, ``y = (l_returnflag = 'R')``
and three deterministic "models": ``price = l_extendedprice / max``,
``discount = l_discount * 10`` (heavily tied) and ``quantity =
l_quantity / 50``.  A second fixture scores ``labels`` joined to
``documents`` by ``n_chars``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.operators import ensemble as en
from riskframe.operators import metrics as mt
from riskframe.operators import rank as rk
from riskframe.operators import stats as st
from riskframe.operators.prefix import prefix_sums
from riskframe.plans.common import lineitem, round_doubles, table
from riskframe.plans.registry import register

MODELS = {"price": "s_price", "discount": "s_discount", "quantity": "s_quantity"}

WIDE_SQL = ("w AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linestatus) AS row_id, "
            "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, "
            "l_extendedprice / (SELECT max(l_extendedprice) FROM lineitem) AS s_price, "
            "l_discount * 10 AS s_discount, l_quantity / 50 AS s_quantity FROM lineitem)")
LONG_SQL = WIDE_SQL + ", s AS (" + " UNION ALL ".join(
    f"SELECT row_id, y, '{m}' AS model, {c} AS score FROM w" for m, c in MODELS.items()) + ")"


def wide_scores(spark, sf):
    li = lineitem(spark, sf)
    mx = li.agg(F.max("l_extendedprice")).scalar()
    return li.select("row_id", (F.col("l_returnflag") == "R").cast("int").alias("y"),
                     (F.col("l_extendedprice") / mx).alias("s_price"),
                     (F.col("l_discount") * 10).alias("s_discount"),
                     (F.col("l_quantity") / 50).alias("s_quantity"))


def long_scores(spark, sf):
    return en.stack_scores(wide_scores(spark, sf), MODELS)


def doc_scores(spark, sf):
    lab = table(spark, sf, "labels")
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    j = en.align_by_row(lab.withColumnRenamed("doc_id", "row_id"), docs.withColumnRenamed("doc_id", "row_id"))
    return en.stack_scores(j.select("row_id", "quality", "toxic", F.col("n_chars").cast("double").alias("s")),
                           {"n_chars": "s"}, keep=["row_id", "quality", "toxic"])


DOC_SQL = ("s AS (SELECT l.doc_id AS row_id, l.quality, l.toxic, 'n_chars' AS model, d.n_chars::DOUBLE AS score "
           "FROM labels l JOIN documents d ON l.doc_id = d.doc_id)")


# ---- U1 / J1 / J2 -----------------------------------------------------------

@register("u1_stack_scores_lineitem",
          f"WITH {LONG_SQL} SELECT row_id, y, model, round(score, 6) AS score FROM s")
def u1_stack_scores_lineitem(spark, sf):
    return round_doubles(long_scores(spark, sf))


@register("u1_union_scores_lineitem",
          f"WITH {LONG_SQL} SELECT row_id, y, model, round(score, 6) AS score FROM s WHERE model <> 'quantity'")
def u1_union_scores_lineitem(spark, sf):
    w = wide_scores(spark, sf)
    frames = {"price": w.select("row_id", "y", F.col("s_price").alias("score")),
              "discount": w.select("row_id", "y", F.col("s_discount").alias("score"))}
    return round_doubles(en.union_scores(frames))


@register("j1_align_by_row_labels",
          "SELECT l.doc_id AS row_id, quality, toxic, n_chars FROM labels l JOIN documents d ON l.doc_id = d.doc_id")
def j1_align_by_row_labels(spark, sf):
    lab = table(spark, sf, "labels").withColumnRenamed("doc_id", "row_id")
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), "n_chars")
    return en.align_by_row(lab, docs)


@register("j2_apply_stats_events",
          "SELECT event_id, round(value, 6) AS value, round((SELECT avg(value) FROM events), 6) AS mu, "
          "round((SELECT stddev_samp(value) FROM events), 6) AS sd FROM events")
def j2_apply_stats_events(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "value")
    stats = ev.agg(F.avg("value").alias("mu"), F.stddev_samp("value").alias("sd"))
    return round_doubles(en.apply_scalar_stats(ev, stats))


# ---- A17-A19 ------------------------------------------------------------------

_CM = ("CAST(sum(CASE WHEN y = 0 AND p = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn, "
       "CAST(sum(CASE WHEN y = 0 AND p = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp, "
       "CAST(sum(CASE WHEN y = 1 AND p = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn, "
       "CAST(sum(CASE WHEN y = 1 AND p = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp")


def _d0(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) = 0 THEN 0.0 ELSE ({a})::DOUBLE / ({b}) END"


@register("a17_a18_confusion_lineitem",
          f"""WITH {LONG_SQL}, c AS (SELECT model, {_CM} FROM (SELECT model, y, CAST(score >= 0.5 AS INTEGER) AS p FROM s)
                                     GROUP BY model)
              SELECT model, tn, fp, fn, tp, round({_d0('tp', 'tp + fp')}, 6) AS precision,
                     round({_d0('tp', 'tp + fn')}, 6) AS recall, round({_d0('2 * tp', '2 * tp + fp + fn')}, 6) AS f1,
                     round({_d0('tp + tn', 'tp + tn + fp + fn')}, 6) AS accuracy, [[tn, fp], [fn, tp]] AS confusion_matrix
              FROM c""")
def a17_a18_confusion_lineitem(spark, sf):
    return round_doubles(mt.confusion(long_scores(spark, sf), 0.5))


@register("a19_classification_report_lineitem",
          f"""WITH {LONG_SQL}, c AS (SELECT model, {_CM} FROM (SELECT model, y, CAST(score >= 0.5 AS INTEGER) AS p FROM s)
                                     GROUP BY model),
              k AS (SELECT model, tn, fp, fn, tp, tp + fp + fn + tn AS n,
                           {_d0('tn', 'tn + fn')} AS p0, {_d0('tn', 'tn + fp')} AS r0, {_d0('2 * tn', '2 * tn + fn + fp')} AS f0,
                           {_d0('tp', 'tp + fp')} AS p1, {_d0('tp', 'tp + fn')} AS r1, {_d0('2 * tp', '2 * tp + fp + fn')} AS f1_,
                           tn + fp AS s0, tp + fn AS s1 FROM c)
              SELECT model, '0' AS label, round(p0, 6) AS precision, round(r0, 6) AS recall, round(f0, 6) AS f1, s0 AS support FROM k
              UNION ALL SELECT model, '1', round(p1, 6), round(r1, 6), round(f1_, 6), s1 FROM k
              UNION ALL SELECT model, 'accuracy', NULL, NULL, round({_d0('tp + tn', 'n')}, 6), n FROM k
              UNION ALL SELECT model, 'macro avg', round((p0 + p1) / 2, 6), round((r0 + r1) / 2, 6), round((f0 + f1_) / 2, 6), n FROM k
              UNION ALL SELECT model, 'weighted avg', round({_d0('p0 * s0 + p1 * s1', 'n')}, 6), round({_d0('r0 * s0 + r1 * s1', 'n')}, 6),
                               round({_d0('f0 * s0 + f1_ * s1', 'n')}, 6), n FROM k""")
def a19_classification_report_lineitem(spark, sf):
    return round_doubles(mt.classification_report(long_scores(spark, sf), 0.5))


# ---- A20 / A21 ------------------------------------------------------------------

def _rank_metrics_sql(cte: str, y: str = "y") -> str:
    return f"""WITH {cte},
      r AS (SELECT model, {y} AS y, score, rank() OVER (PARTITION BY model ORDER BY score) AS rk,
                   count(*) OVER (PARTITION BY model, score) AS c FROM s),
      m AS (SELECT model, sum(y) AS P, sum(1 - y) AS N,
                   sum(CASE WHEN y = 1 THEN rk + (c - 1) / 2.0 ELSE 0 END) AS rsum FROM r GROUP BY model),
      h AS (SELECT model, score, sum({y}) AS pos, sum(1 - {y}) AS neg FROM s GROUP BY model, score),
      c AS (SELECT *, sum(pos) OVER (PARTITION BY model ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp,
                   sum(neg) OVER (PARTITION BY model ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS fp,
                   sum(pos) OVER (PARTITION BY model) AS P FROM h),
      a AS (SELECT model, CASE WHEN max(P) > 0 THEN sum(pos::DOUBLE / P * tp / (tp + fp)) END AS ap FROM c GROUP BY model)
    SELECT m.model, round(CASE WHEN P * N > 0 THEN (rsum - P * (P + 1) / 2.0) / (P * N) END, 6) AS roc_auc,
           round(a.ap, 6) AS pr_auc, CAST(P AS BIGINT) AS n_pos, CAST(N AS BIGINT) AS n_neg
    FROM m JOIN a ON m.model = a.model"""


@register("a20_a21_ranking_metrics_lineitem", _rank_metrics_sql(LONG_SQL))
def a20_a21_ranking_metrics_lineitem(spark, sf):
    return round_doubles(mt.ranking_metrics(long_scores(spark, sf)))


@register("a20_a21_ranking_metrics_labels_quality", _rank_metrics_sql(DOC_SQL, "quality"))
def a20_a21_ranking_metrics_labels_quality(spark, sf):
    return round_doubles(mt.ranking_metrics(doc_scores(spark, sf), y="quality"))


@register("a20_a21_ranking_metrics_labels_toxic", _rank_metrics_sql(DOC_SQL, "toxic"))
def a20_a21_ranking_metrics_labels_toxic(spark, sf):
    return round_doubles(mt.ranking_metrics(doc_scores(spark, sf), y="toxic"))


# ---- A22 / A23 / A24 -------------------------------------------------------------

def _grid_sql(grid: list[float]) -> str:
    vals = ", ".join(f"({i}, {repr(float(t))}::DOUBLE)" for i, t in enumerate(grid))
    return f"g(t_idx, threshold) AS (VALUES {vals})"


def _sweep_sql(grid: list[float]) -> str:
    return f"""WITH {LONG_SQL}, {_grid_sql(grid)},
      x AS (SELECT s.model, g.t_idx, g.threshold,
                   CAST(sum(CASE WHEN s.y = 1 AND s.score >= g.threshold THEN 1 ELSE 0 END) AS BIGINT) AS tp,
                   CAST(sum(CASE WHEN s.y = 0 AND s.score >= g.threshold THEN 1 ELSE 0 END) AS BIGINT) AS fp,
                   CAST(sum(CASE WHEN s.y = 1 AND s.score < g.threshold THEN 1 ELSE 0 END) AS BIGINT) AS fn
            FROM s, g GROUP BY s.model, g.t_idx, g.threshold)"""


LIN200 = mt.linspace_grid(0.01, 0.99, 200)
STEP16 = mt.step_grid(0.1, 0.9, 0.05)


@register("a22_threshold_sweep_lineitem",
          _sweep_sql(LIN200) + f""" SELECT model, t_idx, round(threshold, 6) AS threshold, tp, fp, fn,
              round({_d0('tp', 'tp + fp')}, 6) AS precision, round({_d0('tp', 'tp + fn')}, 6) AS recall,
              round({_d0('2 * tp', '2 * tp + fp + fn')}, 6) AS f1 FROM x""")
def a22_threshold_sweep_lineitem(spark, sf):
    return round_doubles(mt.threshold_sweep(long_scores(spark, sf), LIN200))


@register("a22_best_threshold_lineitem",
          _sweep_sql(STEP16) + f""", f AS (SELECT model, t_idx, threshold, {_d0('2 * tp', '2 * tp + fp + fn')} AS f1 FROM x)
              SELECT model, round(CASE WHEN max(f1) > 0 THEN arg_min(threshold, (-f1, t_idx)) ELSE 0.5 END, 6) AS threshold,
                     round(max(f1), 6) AS f1 FROM f GROUP BY model""")
def a22_best_threshold_lineitem(spark, sf):
    sweep = mt.threshold_sweep(long_scores(spark, sf), STEP16)
    return round_doubles(mt.best_threshold(sweep, default=0.5))


@register("a23_evaluate_lineitem",
          f"""WITH m AS ({_rank_metrics_sql(LONG_SQL)}),
                  {LONG_SQL},
                  c AS (SELECT model, {_CM} FROM (SELECT model, y, CAST(score >= 0.5 AS INTEGER) AS p FROM s) GROUP BY model)
              SELECT c.model, 0.5::DOUBLE AS threshold, m.roc_auc AS ROC_AUC, m.pr_auc AS PR_AUC,
                     round({_d0('2 * tp', '2 * tp + fp + fn')}, 6) AS F1, round({_d0('tp', 'tp + fp')}, 6) AS Precision,
                     round({_d0('tp', 'tp + fn')}, 6) AS Recall, [[tn, fp], [fn, tp]] AS Confusion_Matrix,
                     'score >= 0.5' AS notes
              FROM c JOIN m ON c.model = m.model""")
def a23_evaluate_lineitem(spark, sf):
    ev = mt.evaluate(long_scores(spark, sf), 0.5, notes="score >= 0.5", with_timestamp=False)
    return round_doubles(ev)


@register("a24_score_spread_lineitem",
          f"""WITH m AS ({_rank_metrics_sql(LONG_SQL)})
              SELECT min(roc_auc) AS "min", max(roc_auc) AS "max", round(stddev_pop(roc_auc), 6) AS std_pop,
                     round(avg(roc_auc), 6) AS mean, count(*) AS n FROM m""")
def a24_score_spread_lineitem(spark, sf):
    aucs = round_doubles(mt.ranking_metrics(long_scores(spark, sf)))
    return round_doubles(st.score_spread(aucs, "roc_auc"))


# ---- W1-W5, F3 ----------------------------------------------------------------------

@register("w1_average_rank_lineitem",
          f"""WITH {LONG_SQL}
              SELECT row_id, model, round((rank() OVER (PARTITION BY model ORDER BY score)
                     + (count(*) OVER (PARTITION BY model, score) - 1) / 2.0)
                     / count(*) OVER (PARTITION BY model), 6) AS rank_pct FROM s""")
def w1_average_rank_lineitem(spark, sf):
    r = rk.average_rank(long_scores(spark, sf), "score", ["model"])
    return round_doubles(r.select("row_id", "model", "rank_pct"))


_DAY = "CAST(year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) AS INTEGER)"


@register("w2_prefix_sums_orders",
          f"""WITH h AS (SELECT o_orderpriority, {_DAY} AS day, count(*) AS n, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS amount
                         FROM orders GROUP BY o_orderpriority, day)
              SELECT o_orderpriority, day, n, CAST(amount AS BIGINT) AS amount,
                     CAST(sum(n) OVER (PARTITION BY o_orderpriority ORDER BY day ROWS UNBOUNDED PRECEDING) AS BIGINT) AS n_cum,
                     CAST(sum(amount) OVER (PARTITION BY o_orderpriority ORDER BY day ROWS UNBOUNDED PRECEDING) AS BIGINT) AS amount_cum,
                     CAST(sum(n) OVER (PARTITION BY o_orderpriority) AS BIGINT) AS n_tot,
                     CAST(sum(amount) OVER (PARTITION BY o_orderpriority) AS BIGINT) AS amount_tot FROM h""")
def w2_prefix_sums_orders(spark, sf):
    o = table(spark, sf, "orders")
    day = (F.year("o_orderdate") * 10000 + F.month("o_orderdate") * 100 + F.dayofmonth("o_orderdate"))
    h = o.groupBy("o_orderpriority", day.alias("day")).agg(F.count(F.lit(1)).alias("n"),
                                                          F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("amount"))
    return round_doubles(prefix_sums(h, "day", ["n", "amount"], by=["o_orderpriority"]))


@register("w3_latest_per_key_events",
          "SELECT user_id, arg_max(event_id, ts) AS event_id, arg_max(event_type, ts) AS event_type, "
          "round(arg_max(value, ts), 6) AS value FROM events GROUP BY user_id")
def w3_latest_per_key_events(spark, sf):
    ev = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return round_doubles(rk.latest_per_key(ev, ["user_id"], "ts").drop("ts"))


def _qbin_sql(tab: str, col: str, key: str, q: int = 10) -> str:
    probs = ", ".join(repr(i / q) for i in range(q + 1))
    return f"""WITH e AS (SELECT list_sort(list_distinct(quantile_cont({col}, [{probs}]))) AS edges FROM {tab})
              SELECT {key}, CASE WHEN {col} IS NULL OR {col} < edges[1] OR {col} > edges[len(edges)] THEN NULL
                     ELSE CAST(greatest(len(list_filter(edges, lambda x: x < {col})) - 1, 0) AS INTEGER) END AS {col}_bin
              FROM {tab}, e"""


@register("w4_quantile_bin_events", _qbin_sql("events", "value", "event_id"))
def w4_quantile_bin_events(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "value")
    return rk.quantile_bin(ev, "value", 10).select("event_id", "value_bin")


@register("w4_quantile_bin_lineitem_ties",
          _qbin_sql("lineitem", "l_discount", "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linestatus) AS row_id"))
def w4_quantile_bin_lineitem_ties(spark, sf):
    li = lineitem(spark, sf).select("row_id", "l_discount")
    return rk.quantile_bin(li, "l_discount", 10).select("row_id", "l_discount_bin")


_FOLD_SQL = ("f AS (SELECT row_id, y, CAST((row_number() OVER (PARTITION BY y ORDER BY md5('42-' || row_id::VARCHAR)) - 1) % 5"
             " AS INTEGER) AS fold FROM (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linestatus) AS row_id, "
             "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y FROM lineitem))")


@register("w5_stratified_folds_lineitem", f"WITH {_FOLD_SQL} SELECT row_id, y, fold FROM f")
def w5_stratified_folds_lineitem(spark, sf):
    li = lineitem(spark, sf).select("row_id", (F.col("l_returnflag") == "R").cast("int").alias("y"))
    return rk.stratified_folds(li, "y", 5, 42).select("row_id", "y", "fold")


@register("f3_fold_split_lineitem",
          f"WITH {_FOLD_SQL} SELECT CASE WHEN fold = 0 THEN 'valid' ELSE 'train' END AS part, y, count(*) AS n "
          "FROM f GROUP BY part, y")
def f3_fold_split_lineitem(spark, sf):
    li = lineitem(spark, sf).select("row_id", (F.col("l_returnflag") == "R").cast("int").alias("y"))
    folded = rk.stratified_folds(li, "y", 5, 42)
    train, valid = rk.fold_split(folded, 0)
    c = lambda d, name: d.groupBy("y").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "y", "n")
    return c(train, "train").unionByName(c(valid, "valid"))


# ---- E1-E7, F4 ------------------------------------------------------------------------

@register("e1_mean_blend_lineitem",
          f"WITH {WIDE_SQL} SELECT row_id, y, round((s_price + s_discount + s_quantity) / 3, 6) AS score FROM w")
def e1_mean_blend_lineitem(spark, sf):
    return round_doubles(en.mean_blend(long_scores(spark, sf)))


@register("e2_weighted_blend_lineitem",
          f"WITH {WIDE_SQL} SELECT row_id, y, round(0.5 * s_price + 0.3 * s_discount + 0.2 * s_quantity, 6) AS score FROM w")
def e2_weighted_blend_lineitem(spark, sf):
    return round_doubles(en.weighted_blend(long_scores(spark, sf), {"price": 0.5, "discount": 0.3, "quantity": 0.2}))


_RANKS = (f"WITH {LONG_SQL}, r AS (SELECT row_id, y, model, (rank() OVER (PARTITION BY model ORDER BY score)"
          " + (count(*) OVER (PARTITION BY model, score) - 1) / 2.0) / count(*) OVER (PARTITION BY model) AS rp FROM s)")


@register("e3_rank_blend_lineitem", _RANKS + " SELECT row_id, any_value(y) AS y, round(avg(rp), 6) AS score FROM r GROUP BY row_id")
def e3_rank_blend_lineitem(spark, sf):
    return round_doubles(en.rank_blend(long_scores(spark, sf)))


@register("e4_weighted_rank_blend_lineitem",
          f"""WITH {LONG_SQL}, r AS (SELECT row_id, y, model, rank() OVER (PARTITION BY model ORDER BY score)
                                     + (count(*) OVER (PARTITION BY model, score) - 1) / 2.0 AS rp FROM s)
              SELECT row_id, any_value(y) AS y, round(sum(CASE model WHEN 'price' THEN 0.5 WHEN 'discount' THEN 0.25
                     ELSE 0.25 END * rp), 6) AS score FROM r GROUP BY row_id""")
def e4_weighted_rank_blend_lineitem(spark, sf):
    # raw average ranks (multiples of 1/2) and dyadic weights keep every
    # partial sum exact, so the check does not depend on summation order
    w = {"price": 0.5, "discount": 0.25, "quantity": 0.25}
    return round_doubles(en.rank_blend(long_scores(spark, sf), w, per_n=False))


E5_GRID = en.simplex_grid(3, 4)


def _e5_sql(grid=None) -> str:
    cands = ", ".join(f"({i}, {w[0]!r}::DOUBLE, {w[1]!r}::DOUBLE, {w[2]!r}::DOUBLE)" for i, w in enumerate(grid or E5_GRID))
    return f"""WITH {WIDE_SQL}, c(candidate, w1, w2, w3) AS (VALUES {cands}),
      b AS (SELECT c.candidate, w.y, c.w1 * w.s_price + c.w2 * w.s_discount + c.w3 * w.s_quantity AS score FROM w, c),
      r AS (SELECT candidate, y, rank() OVER (PARTITION BY candidate ORDER BY score) AS rk,
                   count(*) OVER (PARTITION BY candidate, score) AS n FROM b),
      m AS (SELECT candidate, sum(y) AS P, sum(1 - y) AS N, sum(CASE WHEN y = 1 THEN rk + (n - 1) / 2.0 ELSE 0 END) AS rs
            FROM r GROUP BY candidate)
    SELECT m.candidate, [round(w1, 6), round(w2, 6), round(w3, 6)] AS weights,
           round((rs - P * (P + 1) / 2.0) / (P * N), 6) AS roc_auc FROM m JOIN c ON m.candidate = c.candidate"""


@register("e5_weight_search_lineitem", _e5_sql())
def e5_weight_search_lineitem(spark, sf):
    return round_doubles(en.weight_search(wide_scores(spark, sf), list(MODELS.values()), E5_GRID))


@register("e5_best_weights_lineitem",
          f"WITH x AS ({_e5_sql()}) SELECT arg_min(candidate, (-roc_auc, candidate)) AS candidate, "
          "arg_min(weights, (-roc_auc, candidate)) AS weights, max(roc_auc) AS roc_auc FROM x")
def e5_best_weights_lineitem(spark, sf):
    search = round_doubles(en.weight_search(wide_scores(spark, sf), list(MODELS.values()), E5_GRID))
    return en.best_candidate(search)


#: As many draws as the rank blends are searched with.
E5_DRAWS = en.sequential_simplex(500, seed=42)


@register("e5_best_of_500_draws_lineitem",
          f"WITH x AS ({_e5_sql(E5_DRAWS)}) SELECT arg_min(candidate, (-roc_auc, candidate)) AS candidate, "
          "arg_min(weights, (-roc_auc, candidate)) AS weights, max(roc_auc) AS roc_auc FROM x")
def e5_best_of_500_draws_lineitem(spark, sf):
    return en.best_candidate(round_doubles(en.weight_search(wide_scores(spark, sf), list(MODELS.values()), E5_DRAWS)))


@register("f4_no_survivor_lineitem",
          f"WITH {LONG_SQL} SELECT DISTINCT row_id, y, 0.0::DOUBLE AS score FROM s")
def f4_no_survivor_lineitem(spark, sf):
    """No model qualifies: every row scores 0."""
    return en.qualified_rank_blend(long_scores(spark, sf), min_auc=1.1, on_empty="zeros")


@register("e6_pick_method_lineitem",
          f"""WITH {LONG_SQL},
              r AS (SELECT row_id, y, model, (rank() OVER (PARTITION BY model ORDER BY score)
                           + (count(*) OVER (PARTITION BY model, score) - 1) / 2.0)
                           / count(*) OVER (PARTITION BY model) AS rp FROM s),
              eq AS (SELECT row_id, any_value(y) AS y, avg(rp) AS score FROM r GROUP BY row_id),
              wt AS (SELECT row_id, any_value(y) AS y, sum(CASE model WHEN 'price' THEN 0.6 WHEN 'discount' THEN 0.1
                            ELSE 0.3 END * rp) AS score FROM r GROUP BY row_id),
              u AS (SELECT 'equal_rank' AS method, 0 AS priority, * FROM eq UNION ALL SELECT 'weighted_rank', 1, * FROM wt),
              k AS (SELECT method, priority, y, rank() OVER (PARTITION BY method ORDER BY score) AS rk,
                           count(*) OVER (PARTITION BY method, score) AS n FROM u),
              m AS (SELECT method, any_value(priority) AS priority,
                           round((sum(CASE WHEN y = 1 THEN rk + (n - 1) / 2.0 ELSE 0 END) - sum(y) * (sum(y) + 1) / 2.0)
                                 / (sum(y) * sum(1 - y)), 6) AS roc_auc FROM k GROUP BY method)
              SELECT arg_min(method, (-roc_auc, priority)) AS method, arg_min(priority, (-roc_auc, priority)) AS priority,
                     max(roc_auc) AS roc_auc FROM m""")
def e6_pick_method_lineitem(spark, sf):
    s = long_scores(spark, sf)
    blends = en.rank_blends(s, {"equal_rank": None, "weighted_rank": {"price": 0.6, "discount": 0.1, "quantity": 0.3}})
    aucs = round_doubles(mt.ranking_metrics(blends))
    res = aucs.select(F.col("model").alias("method"),
                      F.when(F.col("model") == "equal_rank", 0).otherwise(1).alias("priority"), "roc_auc")
    return en.pick_method(res, "roc_auc", "priority")


@register("e7_goal_check_lineitem",
          f"""WITH m AS ({_rank_metrics_sql(LONG_SQL)})
              SELECT model, roc_auc, CAST(roc_auc >= 0.5 AS INTEGER) AS goal_met, round(roc_auc - 0.5, 6) AS delta,
                     round((roc_auc - 0.5) * 100.0 / 0.5, 6) AS delta_pct FROM m""")
def e7_goal_check_lineitem(spark, sf):
    aucs = round_doubles(mt.ranking_metrics(long_scores(spark, sf))).select("model", "roc_auc")
    return round_doubles(en.goal_check(aucs, "roc_auc", 0.5))


@register("f4_qualify_models_lineitem",
          f"""WITH m AS ({_rank_metrics_sql(LONG_SQL)}), {LONG_SQL}
              SELECT model, count(*) AS n, round(sum(score), 6) AS score_sum FROM s
              WHERE model IN (SELECT model FROM m WHERE roc_auc >= 0.5) GROUP BY model""")
def f4_qualify_models_lineitem(spark, sf):
    q = en.qualify_models(long_scores(spark, sf), 0.5)
    return round_doubles(q.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("score_sum")))


@register("e_ensemble_name_lineitem",
          f"""WITH m AS ({_rank_metrics_sql(LONG_SQL)})
              SELECT array_to_string(list_sort(list(model)), '_') AS ensemble, count(*) AS n_models
              FROM m WHERE roc_auc >= 0.5""")
def e_ensemble_name_lineitem(spark, sf):
    """The ensemble's name: qualifying model keys, sorted, joined by '_'."""
    aucs = round_doubles(mt.ranking_metrics(long_scores(spark, sf)))
    q = aucs.where(F.col("roc_auc") >= 0.5)
    return q.agg(F.array_join(F.sort_array(F.collect_set("model")), "_").alias("ensemble"),
                 F.count(F.lit(1)).alias("n_models"))
