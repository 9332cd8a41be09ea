"""Registered queries: scans, projections, features and robust statistics.

Each entry pairs a Spark query (whole driver tables) with an independent
DuckDB statement over the same parquet views.  Doubles are rounded to six
places on both sides.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.functions import features as fx
from riskframe.operators import stats as st
from riskframe.operators.quantiles import iqr_fences, quantiles
from riskframe.plans.common import LINEITEM_V, lineitem, round_doubles, table
from riskframe.plans.eda import outlier_profile
from riskframe.plans.registry import ORACLE, register

EV_COLS = ["event_id", "user_id", "value"]
LI_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
          "l_extendedprice", "l_discount", "l_tax"]


# ---- SQL helpers (oracle side) ---------------------------------------------

def _fences_cte(tab: str, cols: list[str], k: float = 1.5) -> str:
    qs = ", ".join(f"quantile_cont({c}, 0.25) AS {c}_q1, quantile_cont({c}, 0.75) AS {c}_q3" for c in cols)
    fs = ", ".join(f"{c}_q1 - {k} * ({c}_q3 - {c}_q1) AS {c}_lo, {c}_q3 + {k} * ({c}_q3 - {c}_q1) AS {c}_hi"
                   for c in cols)
    return f"q AS (SELECT {qs} FROM {tab}), f AS (SELECT {fs} FROM q)"


def _outlier_sql(tab: str, cols: list[str]) -> str:
    parts = [f"SELECT '{c}' AS feature, CAST(count(*) FILTER (WHERE t.{c} < f.{c}_lo OR t.{c} > f.{c}_hi) AS BIGINT)"
             f" AS outlier_count FROM {tab} t, f" for c in cols]
    return f"WITH {_fences_cte(tab, cols)} " + " UNION ALL ".join(parts)


# ---- S1 / P1-P4 -------------------------------------------------------------

@register("s1_read_table_lineitem",
          "SELECT l_orderkey, l_linenumber, round(l_quantity, 6) AS l_quantity, "
          "round(l_extendedprice, 6) AS l_extendedprice, round(l_discount, 6) AS l_discount, "
          "round(l_tax, 6) AS l_tax, l_returnflag FROM lineitem")
def s1_read_table_lineitem(spark, sf):
    df = table(spark, sf, "lineitem")
    return round_doubles(df.select("l_orderkey", "l_linenumber", *LINEITEM_V, "l_returnflag"))


@register("p1_drop_cols_customer",
          "SELECT c_custkey, c_nationkey, round(c_acctbal, 6) AS c_acctbal, c_mktsegment FROM customer")
def p1_drop_cols_customer(spark, sf):
    df = fx.drop_cols(table(spark, sf, "customer"), ["c_name", "KMeans_Cluster", "DBSCAN_Cluster"])
    return round_doubles(df)


@register("p2_select_except_orders",
          "SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 6) AS o_totalprice FROM orders")
def p2_select_except_orders(spark, sf):
    df = fx.select_except(table(spark, sf, "orders"),
                          lambda c: c not in ("o_orderdate", "o_orderpriority"))
    return round_doubles(df)


@register("p3_numeric_columns_lineitem",
          "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(l_quantity, 6) AS l_quantity, "
          "round(l_extendedprice, 6) AS l_extendedprice, round(l_discount, 6) AS l_discount, "
          "round(l_tax, 6) AS l_tax FROM lineitem")
def p3_numeric_columns_lineitem(spark, sf):
    df = table(spark, sf, "lineitem")
    return round_doubles(df.select(*fx.numeric_columns(df)))


@register("p4_slice_columns_lineitem",
          "SELECT l_partkey, l_suppkey, l_linenumber, round(l_quantity, 6) AS l_quantity FROM lineitem")
def p4_slice_columns_lineitem(spark, sf):
    return round_doubles(fx.slice_columns(table(spark, sf, "lineitem"), 1, 5))


# ---- P6-P16 features --------------------------------------------------------

_SEC = "(hour(ts) * 3600 + minute(ts) * 60 + second(ts))::DOUBLE"


@register("p6_p9_time_features_events",
          f"""SELECT event_id, round(ln(1 + value), 6) AS log_amount, round(sec, 6) AS seconds,
                 round(hr, 6) AS hour, round(sin(2 * pi() * sec / 86400.0), 6) AS time_sin,
                 round(cos(2 * pi() * sec / 86400.0), 6) AS time_cos,
                 round(sin(2 * pi() * hr / 24.0), 6) AS hour_sin, round(cos(2 * pi() * hr / 24.0), 6) AS hour_cos
              FROM (SELECT event_id, value, {_SEC} AS sec,
                           floor(((({_SEC} % 86400) + 86400) % 86400) / 3600)::DOUBLE AS hr FROM events)""")
def p6_p9_time_features_events(spark, sf):
    ev = table(spark, sf, "events")
    sec = fx.second_of_day("ts")
    hr = fx.hour_of_day(sec)
    ts, tc = fx.cyclic_time(sec)
    hs, hc = fx.cyclic_hour(hr)
    out = ev.select("event_id", fx.log_amount("value").alias("log_amount"), sec.alias("seconds"),
                    hr.alias("hour"), ts.alias("time_sin"), tc.alias("time_cos"),
                    hs.alias("hour_sin"), hc.alias("hour_cos"))
    return round_doubles(out)


NORM_V = ["l_quantity", "l_discount", "l_tax"]


def _crosses_sql() -> str:
    v = LINEITEM_V
    norm = "sqrt(" + " + ".join(f"{c} * {c}" for c in NORM_V) + ")"
    sel = ["concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linestatus) AS row_id", "ln(1 + l_extendedprice) AS log_amount"]
    sel += [f"ln(1 + l_extendedprice) * {c} AS amt_x_{c}" for c in ("l_quantity", "l_discount", "l_tax")]
    sel += [f"{norm} AS v_norm", f"pow({norm}, 2) AS v_norm_pow2", f"pow({norm}, 3) AS v_norm_pow3"]
    sel += [f"{norm} * {c} AS norm_x_{c}" for c in v]
    sel += [f"{a} * {b} AS {a}_x_{b}" for i, a in enumerate(NORM_V) for b in NORM_V[i + 1:]]
    sel += [f"{c} * {c} AS {c}_sq" for c in NORM_V]
    names = [s.rsplit(" AS ", 1)[1] for s in sel]
    inner = ", ".join(sel)
    outer = ", ".join(["row_id"] + [f"round({n}, 6) AS {n}" for n in names[1:]])
    return f"SELECT {outer} FROM (SELECT {inner} FROM lineitem)"


@register("p10_p15_crosses_lineitem", _crosses_sql())
def p10_p15_crosses_lineitem(spark, sf):
    li = lineitem(spark, sf)
    la = fx.log_amount("l_extendedprice")
    norm = fx.row_norm(NORM_V)
    exprs = [la.alias("log_amount"),
             *fx.cross_with(la, ["l_quantity", "l_discount", "l_tax"], "amt_x_"),
             norm.alias("v_norm"), *fx.norm_powers(norm, (2, 3), "v_norm"),
             *fx.cross_with(norm, LINEITEM_V, "norm_x_"),
             *fx.pairwise_products(NORM_V), *fx.squares(NORM_V)]
    return round_doubles(fx.with_features(li, exprs, keep=["row_id"]))


@register("p11_array_norm_embeddings",
          "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6)"
          " AS v_norm FROM embeddings")
def p11_array_norm_embeddings(spark, sf):
    em = table(spark, sf, "embeddings")
    return round_doubles(em.select("vec_id", fx.array_norm("embedding").alias("v_norm")))


@register("p16_ratio_features_customer",
          """WITH a AS (SELECT o_custkey, ln(1 + sum(o_totalprice)) AS spend, ln(1 + count(*)) AS n_orders,
                        ln(1 + max(o_totalprice)) AS top_order FROM orders GROUP BY o_custkey)
             SELECT o_custkey, round(spend / (n_orders + 1), 6) AS spend_per_order,
                    round(top_order / (spend + 1), 6) AS top_share,
                    round(CASE WHEN c_acctbal + 1 = 0 THEN NULL ELSE spend / (c_acctbal + 1) END, 6) AS spend_to_balance
             FROM a JOIN customer ON c_custkey = o_custkey""")
def p16_ratio_features_customer(spark, sf):
    orders = table(spark, sf, "orders")
    cust = table(spark, sf, "customer")
    a = orders.groupBy("o_custkey").agg(
        fx.log_amount(F.sum("o_totalprice")).alias("spend"),
        fx.log_amount(F.count(F.lit(1))).alias("n_orders"),
        fx.log_amount(F.max("o_totalprice")).alias("top_order"))
    j = a.join(cust, a.o_custkey == cust.c_custkey)
    out = j.select("o_custkey", fx.safe_ratio("spend", "n_orders").alias("spend_per_order"),
                   fx.safe_ratio("top_order", "spend").alias("top_share"),
                   fx.safe_ratio("spend", "c_acctbal").alias("spend_to_balance"))
    return round_doubles(out)


@register("p17_clip_part",
          "SELECT p_partkey, CASE WHEN s > 45 THEN 45 WHEN s < 5 THEN 5 ELSE s END AS p_size_clipped "
          "FROM (SELECT p_partkey, CAST(nullif(p_size, 1) AS DOUBLE) AS s FROM part)")
def p17_clip_part(spark, sf):
    part = table(spark, sf, "part")
    s = F.nullif(F.col("p_size"), F.lit(1)).cast("double")
    return round_doubles(part.select("p_partkey", fx.clip(s, 5, 45).alias("p_size_clipped")))


@register("p18_threshold_label_lineitem",
          "SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linestatus) AS row_id, "
          "CAST(l_extendedprice / (SELECT max(l_extendedprice) FROM lineitem) >= 0.5 AS INTEGER) AS pred FROM lineitem")
def p18_threshold_label_lineitem(spark, sf):
    li = lineitem(spark, sf)
    mx = li.agg(F.max("l_extendedprice")).scalar()
    return li.select("row_id", fx.threshold_label(F.col("l_extendedprice") / mx, 0.5).alias("pred"))


@register("p19_class_weight_lineitem",
          """WITH y AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linestatus) AS row_id,
                               CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y FROM lineitem),
                  c AS (SELECT sum(1 - y)::DOUBLE / sum(y) AS r FROM y)
             SELECT row_id, y, round(CASE WHEN y = 1 THEN c.r ELSE 1.0 END, 6) AS weight FROM y, c""")
def p19_class_weight_lineitem(spark, sf):
    li = lineitem(spark, sf).select("row_id", (F.col("l_returnflag") == "R").cast("int").alias("y"))
    return round_doubles(st.with_class_weight(li, "y"))


@register("p20_balanced_weight_labels",
          """WITH c AS (SELECT toxic, count(*) AS n_c FROM labels GROUP BY toxic),
                  t AS (SELECT sum(n_c) AS n, count(*) AS k FROM c)
             SELECT doc_id, toxic, round(t.n::DOUBLE / (t.k * c.n_c), 6) AS weight
             FROM labels JOIN c USING (toxic), t""")
def p20_balanced_weight_labels(spark, sf):
    lab = table(spark, sf, "labels").select("doc_id", "toxic")
    return round_doubles(st.with_balanced_weight(lab, "toxic"))


# ---- A1 / A2 / A13 ------------------------------------------------------------

@register("a1_shape_lineitem", "SELECT count(*) AS n_rows, 11 AS n_cols FROM lineitem")
def a1_shape_lineitem(spark, sf):
    return st.shape(table(spark, sf, "lineitem"))


@register("a2_class_counts_lineitem",
          """SELECT CAST(sum(1 - y) AS BIGINT) AS n_neg, CAST(sum(y) AS BIGINT) AS n_pos,
                    round(avg(y::DOUBLE), 6) AS pos_rate, round(sum(1 - y)::DOUBLE / sum(y), 6) AS neg_pos_ratio
             FROM (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y FROM lineitem)""")
def a2_class_counts_lineitem(spark, sf):
    li = table(spark, sf, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"))
    return round_doubles(st.class_counts(li, "y"))


def _part_nulls(spark, sf):
    part = table(spark, sf, "part")
    return part.withColumn("p_size", F.nullif(F.col("p_size"), F.lit(1)))


_PART_COLS = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]


@register("a13_null_counts_part",
          "WITH p AS (SELECT p_partkey, p_name, p_brand, p_type, nullif(p_size, 1) AS p_size, p_retailprice FROM part) "
          + " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST(count(*) - count({c}) AS BIGINT) AS n_null FROM p"
                               for c in _PART_COLS)
          + " UNION ALL SELECT '__total__' AS feature, CAST(" + " + ".join(
              f"(count(*) - count({c}))" for c in _PART_COLS) + " AS BIGINT) AS n_null FROM p")
def a13_null_counts_part(spark, sf):
    return st.null_counts(_part_nulls(spark, sf), _PART_COLS)


# ---- A3-A9 ----------------------------------------------------------------------

_PROBS = [0.25, 0.5, 0.75, 0.999]


@register("a3_quantiles_lineitem",
          " UNION ALL ".join(f"SELECT '{c}' AS feature, {p}::DOUBLE AS p, round(quantile_cont({c}, {p}), 6) AS q"
                             f" FROM lineitem" for c in LINEITEM_V for p in _PROBS))
def a3_quantiles_lineitem(spark, sf):
    return round_doubles(quantiles(table(spark, sf, "lineitem"), LINEITEM_V, _PROBS))


@register("a3_quantiles_events",
          " UNION ALL ".join(f"SELECT '{c}' AS feature, {p}::DOUBLE AS p, round(quantile_cont({c}, {p}), 6) AS q"
                             f" FROM events" for c in ["value", "user_id"] for p in [0.01, 0.5, 0.99]))
def a3_quantiles_events(spark, sf):
    return round_doubles(quantiles(table(spark, sf, "events"), ["value", "user_id"], [0.01, 0.5, 0.99]))


@register("a4_iqr_fences_events",
          f"WITH {_fences_cte('events', ['value', 'user_id'])} "
          + " UNION ALL ".join(f"SELECT '{c}' AS feature, round({c}_q1, 6) AS q1, round({c}_q3, 6) AS q3, "
                               f"round({c}_q3 - {c}_q1, 6) AS iqr, round({c}_lo, 6) AS lower, round({c}_hi, 6) AS upper "
                               f"FROM q, f" for c in ["value", "user_id"]))
def a4_iqr_fences_events(spark, sf):
    return round_doubles(iqr_fences(table(spark, sf, "events"), ["value", "user_id"]))


@register("a5_outlier_counts_events", _outlier_sql("events", EV_COLS))
def a5_outlier_counts_events(spark, sf):
    return outlier_profile(table(spark, sf, "events"))


@register("a5_outlier_counts_lineitem", _outlier_sql("lineitem", LI_NUM))
def a5_outlier_counts_lineitem(spark, sf):
    return outlier_profile(table(spark, sf, "lineitem"))


@register("a6_iqr_cap_report_events",
          f"WITH {_fences_cte('events', EV_COLS)} "
          + " UNION ALL ".join(
              f"SELECT '{c}' AS feature, CAST(count(*) FILTER (WHERE t.{c} < f.{c}_lo) AS BIGINT) AS capped_low, "
              f"CAST(count(*) FILTER (WHERE t.{c} > f.{c}_hi) AS BIGINT) AS capped_high, "
              f"CAST(count(*) FILTER (WHERE t.{c} < f.{c}_lo OR t.{c} > f.{c}_hi) AS BIGINT) AS total_capped "
              f"FROM events t, f" for c in EV_COLS))
def a6_iqr_cap_report_events(spark, sf):
    _, report = st.iqr_cap(table(spark, sf, "events").select(*EV_COLS), EV_COLS)
    return report


@register("a6_iqr_capped_events",
          f"WITH {_fences_cte('events', ['value', 'user_id'])} "
          "SELECT event_id, CAST(CASE WHEN user_id > f.user_id_hi THEN f.user_id_hi WHEN user_id < f.user_id_lo "
          "THEN f.user_id_lo ELSE user_id END AS DOUBLE) AS user_id, "
          "round(CASE WHEN value > f.value_hi THEN f.value_hi WHEN value < f.value_lo THEN f.value_lo "
          "ELSE value END, 6) AS value FROM events, f")
def a6_iqr_capped_events(spark, sf):
    ev = table(spark, sf, "events").select("event_id", F.col("user_id").cast("double").alias("user_id"), "value")
    capped, _ = st.iqr_cap(ev, ["value", "user_id"])
    return round_doubles(capped)


@register("a7_iqr_drop_events",
          f"WITH {_fences_cte('events', ['value', 'user_id'])} "
          "SELECT event_id, round(value, 6) AS value FROM events, f WHERE NOT (value < f.value_lo OR value > f.value_hi) "
          "AND NOT (user_id < f.user_id_lo OR user_id > f.user_id_hi)")
def a7_iqr_drop_events(spark, sf):
    ev = table(spark, sf, "events")
    return round_doubles(st.iqr_drop(ev, ["value", "user_id"]).select("event_id", "value"))


@register("a8_coverage_compare_events",
          f"""WITH {_fences_cte('events', ['value', 'user_id'])},
                  c AS (SELECT count(*) AS total_rows,
                               CAST(count(*) FILTER (WHERE NOT (value < f.value_lo OR value > f.value_hi)
                                     AND NOT (user_id < f.user_id_lo OR user_id > f.user_id_hi)) AS BIGINT) AS kept
                        FROM events, f)
             SELECT 'drop' AS approach, kept AS rows_used, total_rows, round(kept * 100.0 / total_rows, 6) AS coverage_pct,
                    NULL::DOUBLE AS score, NULL::DOUBLE AS delta_pct FROM c
             UNION ALL
             SELECT 'cap', total_rows, total_rows, 100.0, NULL::DOUBLE, NULL::DOUBLE FROM c""")
def a8_coverage_compare_events(spark, sf):
    return round_doubles(st.coverage_compare(table(spark, sf, "events"), ["value", "user_id"]))


@register("a9_quantile_cap_events",
          """WITH cap AS (SELECT quantile_cont(value, 0.999) AS c FROM events WHERE ts < TIMESTAMP '2024-01-20')
             SELECT event_id, round(CASE WHEN value > cap.c THEN cap.c ELSE value END, 6) AS value FROM events, cap""")
def a9_quantile_cap_events(spark, sf):
    ev = table(spark, sf, "events")
    train = ev.where(F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz"))
    caps = st.fit_quantile_cap(train, ["value"], 0.999)
    return round_doubles(st.apply_quantile_cap(ev.select("event_id", "value"), caps, ["value"]))


@register("a10_median_impute_part",
          """WITH p AS (SELECT p_partkey, CAST(nullif(p_size, 1) AS DOUBLE) AS p_size FROM part)
             SELECT p_partkey, round(coalesce(p_size, (SELECT quantile_cont(p_size, 0.5) FROM p)), 6) AS p_size FROM p""")
def a10_median_impute_part(spark, sf):
    part = table(spark, sf, "part").select(
        "p_partkey", F.nullif(F.col("p_size"), F.lit(1)).cast("double").alias("p_size"))
    return round_doubles(st.median_impute(part, ["p_size"]))


@register("a11_zscore_events",
          """SELECT event_id, round((value - (SELECT avg(value) FROM events))
                                    / ((SELECT stddev_samp(value) FROM events) + 1e-8), 6) AS value_zscore FROM events""")
def a11_zscore_events(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "value")
    return round_doubles(st.zscore(ev, "value").select("event_id", "value_zscore"))


def _robust_sql() -> str:
    v = LINEITEM_V
    qs = ", ".join(f"quantile_cont({c}, 0.5) AS {c}_m, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS {c}_i"
                   for c in v)
    sel = ", ".join(f"round(({c} - s.{c}_m) / CASE WHEN s.{c}_i = 0 THEN 1.0 ELSE s.{c}_i END, 6) AS {c}" for c in v)
    return (f"WITH s AS (SELECT {qs} FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01') "
            f"SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linestatus) AS row_id, {sel} FROM lineitem, s")


@register("a12_robust_scale_lineitem", _robust_sql())
def a12_robust_scale_lineitem(spark, sf):
    li = lineitem(spark, sf)
    train = li.where(F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz"))
    scaler = st.fit_robust_scaler(train, LINEITEM_V)
    return round_doubles(st.apply_robust_scaler(li.select("row_id", *LINEITEM_V), scaler, LINEITEM_V))


# ---- A14-A16, A27 -----------------------------------------------------------------

@register("a14_group_profile_lineitem",
          "SELECT l_linenumber, " + ", ".join(f"round(round_even(avg({c}), 2), 6) AS {c}" for c in LINEITEM_V)
          + " FROM lineitem GROUP BY l_linenumber")
def a14_group_profile_lineitem(spark, sf):
    li = table(spark, sf, "lineitem")
    return round_doubles(st.group_profile(li, "l_linenumber", LINEITEM_V))


@register("a15_group_sizes_customer",
          "SELECT c_nationkey, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM customer), 6) AS share_pct "
          "FROM customer WHERE c_nationkey >= 0 GROUP BY c_nationkey")
def a15_group_sizes_customer(spark, sf):
    return round_doubles(st.group_sizes(table(spark, sf, "customer"), "c_nationkey"))


@register("a16_cluster_summary_embeddings",
          "SELECT count(DISTINCT CASE WHEN label <> -1 THEN label END) AS n_clusters, "
          "CAST(count(*) FILTER (WHERE label = -1) AS BIGINT) AS n_noise, "
          "round(count(*) FILTER (WHERE label = -1) * 100.0 / count(*), 6) AS noise_pct, count(*) AS n_rows FROM embeddings")
def a16_cluster_summary_embeddings(spark, sf):
    return round_doubles(st.cluster_summary(table(spark, sf, "embeddings"), "label"))


def _box_sql() -> str:
    v = LINEITEM_V
    parts = []
    for c in v:
        parts.append(
            f"SELECT '{c}' AS feature, round(min(t.{c}), 6) AS \"min\", round(any_value(q.{c}_q1), 6) AS q1, "
            f"round(any_value(q.{c}_med), 6) AS median, round(any_value(q.{c}_q3), 6) AS q3, round(max(t.{c}), 6) AS \"max\", "
            f"round(min(t.{c}) FILTER (WHERE t.{c} >= f.{c}_lo AND t.{c} <= f.{c}_hi), 6) AS whisker_low, "
            f"round(max(t.{c}) FILTER (WHERE t.{c} >= f.{c}_lo AND t.{c} <= f.{c}_hi), 6) AS whisker_high, "
            f"CAST(count(*) FILTER (WHERE t.{c} < f.{c}_lo OR t.{c} > f.{c}_hi) AS BIGINT) AS n_outliers "
            f"FROM lineitem t, q, f")
    meds = ", ".join(f"quantile_cont({c}, 0.5) AS {c}_med" for c in v)
    cte = _fences_cte("lineitem", v).replace(" FROM lineitem), f AS", f", {meds} FROM lineitem), f AS")
    return f"WITH {cte} " + " UNION ALL ".join(parts)


@register("a27_boxplot_stats_lineitem", _box_sql())
def a27_boxplot_stats_lineitem(spark, sf):
    return round_doubles(st.boxplot_stats(table(spark, sf, "lineitem"), LINEITEM_V))


# ---- D1, T2, T3, F1 -----------------------------------------------------------------

@register("d1_dedupe_lineitem",
          "SELECT DISTINCT round(l_quantity, 6) AS l_quantity, round(l_discount, 6) AS l_discount, "
          "round(l_tax, 6) AS l_tax FROM lineitem")
def d1_dedupe_lineitem(spark, sf):
    li = table(spark, sf, "lineitem").select("l_quantity", "l_discount", "l_tax")
    out, _ = st.dedupe(li)
    return round_doubles(out)


@register("d1_dedupe_report_lineitem",
          "WITH a AS (SELECT count(*) AS n_before FROM lineitem), "
          "b AS (SELECT count(*) AS n_after FROM (SELECT DISTINCT l_quantity, l_discount, l_tax FROM lineitem)) "
          "SELECT n_before, n_after, n_before - n_after AS n_removed FROM a, b")
def d1_dedupe_report_lineitem(spark, sf):
    li = table(spark, sf, "lineitem").select("l_quantity", "l_discount", "l_tax")
    _, rep = st.dedupe(li)
    return rep


@register("t2_top_k_lineitem",
          "SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linestatus) AS row_id, round(l_extendedprice, 6) AS l_extendedprice FROM lineitem "
          "ORDER BY l_extendedprice DESC, row_id LIMIT 15")
def t2_top_k_lineitem(spark, sf):
    li = lineitem(spark, sf).select("row_id", "l_extendedprice")
    return round_doubles(st.top_k(li, "l_extendedprice", 15, ["row_id"]))


@register("t3_arg_best_lineitem",
          "SELECT l_returnflag, arg_min(row_id, (-l_extendedprice, row_id)) AS row_id, round(max(l_extendedprice), 6) "
          "AS l_extendedprice FROM (SELECT *, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linestatus) AS row_id FROM lineitem) GROUP BY l_returnflag")
def t3_arg_best_lineitem(spark, sf):
    li = lineitem(spark, sf).select("l_returnflag", "row_id", "l_extendedprice")
    return round_doubles(st.arg_best(li, "l_extendedprice", ["row_id"], by=["l_returnflag"]))


@register("f1_outside_fences_events",
          f"WITH {_fences_cte('events', ['value'])} "
          "SELECT event_id, round(value, 6) AS value FROM events, f WHERE value < f.value_lo OR value > f.value_hi")
def f1_outside_fences_events(spark, sf):
    ev = table(spark, sf, "events")
    fences = iqr_fences(ev, ["value"]).first()
    return round_doubles(ev.where(st.outside_fences("value", F.lit(fences.lower), F.lit(fences.upper)))
                         .select("event_id", "value"))


@register("s2_read_optional_labels",
          "SELECT doc_id, quality, toxic, 1 AS has_label FROM labels")
def s2_read_optional_labels(spark, sf):
    import os
    from riskframe.sources import read_optional
    missing, _ = read_optional(spark, os.path.join(sf, "no_such_table.parquet"), label="quality")
    assert missing is None
    df, has = read_optional(spark, os.path.join(sf, "labels.parquet"), label="quality")
    return df.select("doc_id", "quality", "toxic", F.lit(int(has)).alias("has_label"))


# ---- feature-set catalogue on a card-shaped frame ---------------------------------

def card_frame(spark, sf):
    """``embeddings`` as a card-transaction frame: V1..V28 = the first 28
    coordinates, Amount = |coordinate 29| * 1000, Time = vec_id * 173 s,
    Class = label < 2."""
    em = table(spark, sf, "embeddings")
    return em.select(F.col("vec_id").alias("row_id"), (F.col("label") < 2).cast("int").alias("Class"),
                     (F.col("vec_id") * 173).cast("double").alias("Time"),
                     *[F.col("embedding")[i].cast("double").alias(f"V{i + 1}") for i in range(28)],
                     (F.abs(F.col("embedding")[28].cast("double")) * 1000).alias("Amount"))


_CARD_SQL = ("c AS (SELECT vec_id AS row_id, CAST(label < 2 AS INTEGER) AS Class, (vec_id * 173)::DOUBLE AS Time, "
             + ", ".join(f"embedding[{i + 1}]::DOUBLE AS V{i + 1}" for i in range(28))
             + ", abs(embedding[29]::DOUBLE) * 1000 AS Amount FROM embeddings)")
_T1 = ["V1", "V2", "V3", "V4", "V10", "V11", "V12", "V14", "V17"]


@register("p_catalogue_t1_eng_embeddings",
          f"WITH {_CARD_SQL} SELECT row_id, Class, "
          + ", ".join(f"round(V{i}, 6) AS V{i}" for i in range(1, 29))
          + ", round(ln(1 + Amount), 6) AS log_amount, round(sin(2 * pi() * Time / 86400.0), 6) AS time_sin, "
            "round(cos(2 * pi() * Time / 86400.0), 6) AS time_cos, "
            "floor((((Time % 86400) + 86400) % 86400) / 3600)::DOUBLE AS hour, "
          + ", ".join(f"round(ln(1 + Amount) * {v}, 6) AS {v}_x_logamt" for v in _T1) + " FROM c")
def p_catalogue_t1_eng_embeddings(spark, sf):
    from riskframe.functions.catalogue import CATALOGUE, build_feature_set
    out, _ = build_feature_set(card_frame(spark, sf), CATALOGUE["T1_eng"])
    return round_doubles(out)


@register("p_catalogue_t9_sets_embeddings")
def p_catalogue_t9_sets_embeddings(spark, sf):
    """Feature sets A and B of the final trial: feature counts and a
    checksum per set."""
    from riskframe.functions.catalogue import CATALOGUE, build_feature_set
    card = card_frame(spark, sf)
    res = None
    for name in ("T3", "T9_A", "T9_B"):
        built, feats = build_feature_set(card, CATALOGUE[name], fit_on=None)
        agg = built.agg(F.count(F.lit(1)).alias("n_rows"),
                        F.sum(sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in feats), F.lit(0.0)))
                        .alias("checksum")).select(F.lit(name).alias("feature_set"),
                                                   F.lit(len(feats)).alias("n_features"), "n_rows", "checksum")
        res = agg if res is None else res.unionByName(agg)
    return round_doubles(res)


def _feature_set_sql(spec, total: bool = False) -> str:
    """DuckDB SQL for one catalogue set over the card frame, or (``total``)
    for the number of its features and rows and the sum of all its values."""
    vs = [f"V{i}" for i in range(1, 29)]
    norm = "sqrt(0.0 + " + " + ".join(f"{v} * {v}" for v in vs) + ")"
    la, hour = "ln(1 + Amount)", "floor((((Time % 86400) + 86400) % 86400) / 3600)::DOUBLE"
    out = {v: v for v in vs} | ({"Time": "Time", "Amount": "Amount"} if spec.keep_raw else {})
    if spec.log_amount:
        out[spec.log_amount] = la
    if spec.second_cyclic:
        out |= {"time_sin": "sin(2 * pi() * Time / 86400.0)", "time_cos": "cos(2 * pi() * Time / 86400.0)"}
    if spec.hour:
        out[spec.hour] = hour
    out |= {n: f"{f}(2 * pi() * {hour} / 24.0)" for n, f, on in (("Time_sin", "sin", spec.hour_sin), ("Time_cos", "cos", spec.hour_cos)) if on}
    out |= {spec.amount_cross_name.format(v=v): f"{la} * {v}" for v in spec.amount_cross}
    if spec.norm:
        out |= {"V_norm": norm} | {{2: "V_norm_sq", 3: "V_norm_cube"}[k]: f"pow({norm}, {k})" for k in spec.norm_powers}
        out |= {f"Vnorm_x_{v}": f"{norm} * {v}" for v in spec.norm_cross}
    out |= {f"{a}_x_{b}": f"{a} * {b}" for i, a in enumerate(spec.pairs) for b in spec.pairs[i + 1:]}
    out |= {f"{v}_sq": f"{v} * {v}" for v in spec.squares}
    if spec.amount_zscore:
        out["amt_zscore"] = "(Amount - (SELECT avg(Amount) FROM c)) / ((SELECT stddev_samp(Amount) FROM c) + 1e-8)"
    if spec.amount_bin:
        cuts = "(SELECT list_distinct(quantile_cont(Amount, [i / 10.0 FOR i IN range(11)])) FROM c)"
        out["Amount_bin"] = f"greatest(len(list_filter({cuts}, lambda q: q < Amount)) - 1, 0)::INTEGER"
    built = ", ".join(f"{e} AS {n}" for n, e in out.items())
    return f"WITH {_CARD_SQL}, f AS (SELECT row_id, Class, {built} FROM c), " + _scaled_sql(["row_id", "Class"], list(out), list(spec.scale), ["Amount_bin"], total and spec.name)


def _scaled_sql(keep: list[str], cols: list[str], scale: list[str], whole: list[str], total: str | bool = False) -> str:
    """The end of a feature set's SQL: robust scaling of ``scale``, rounding."""
    q = ", ".join(f"quantile_cont({c}, {p}) AS {c}_{n}" for c in scale for n, p in (("q1", 0.25), ("md", 0.5), ("q3", 0.75)))
    fit = f"s AS (SELECT {q} FROM f) " if q else "s AS (SELECT 0 AS none) "
    one = lambda c: (f"({c} - {c}_md) / CASE WHEN {c}_q3 - {c}_q1 = 0 THEN 1.0 ELSE {c}_q3 - {c}_q1 END" if c in scale else c)
    if total:
        both = " + ".join(f"coalesce({one(c)}, 0.0)" for c in cols)
        return fit + f"SELECT '{total}' AS feature_set, {len(cols)} AS n_features, count(*) AS n_rows, round(sum({both}), 6) AS checksum FROM f, s"
    return fit + "SELECT " + ", ".join([*keep, *[f"{one(c)} AS {c}" if c in whole else f"round({one(c)}, 6) AS {c}" for c in cols]]) + " FROM f, s"


def _register_feature_sets() -> None:
    from riskframe.functions.catalogue import CATALOGUE, build_feature_set
    for name, spec in CATALOGUE.items():
        if name == "T1_eng":
            continue        # has a query of its own

        def run(spark, sf, spec=spec):
            return round_doubles(build_feature_set(card_frame(spark, sf), spec)[0])
        run.__name__ = f"p_catalogue_{name.lower()}_embeddings"
        register(run.__name__, _feature_set_sql(spec))(run)


_register_feature_sets()


def _checksum_sql() -> str:
    from riskframe.functions.catalogue import CATALOGUE
    return " UNION ALL ".join(f"({_feature_set_sql(CATALOGUE[n], True)})" for n in ("T3", "T9_A", "T9_B"))


ORACLE["p_catalogue_t9_sets_embeddings"] = _checksum_sql()

_SEGMENT_COLS = ["BALANCE", "PURCHASES", "ONEOFF_PURCHASES", "INSTALLMENTS_PURCHASES", "CASH_ADVANCE", "PAYMENTS", "MINIMUM_PAYMENTS",
                 "CREDIT_LIMIT", "PURCHASES_INSTALLMENTS_FREQUENCY", "CASH_ADVANCE_TRX", "TENURE"]


def _segment_sql() -> str:
    from riskframe.functions.catalogue import SEGMENTS as S
    raw = ", ".join(f"abs(embedding[{i + 1}]::DOUBLE) * 1000 AS {c}" for i, c in enumerate(_SEGMENT_COLS))
    logged = {c: f"ln(1 + {c})" if c in S.skewed else c for c in _SEGMENT_COLS}
    out = {c: e for c, e in logged.items() if c not in S.drop} | {n: f"{logged[a]} / ({logged[b]} + 1.0)" for n, a, b in S.ratios}
    return (f"WITH c AS (SELECT vec_id AS row_id, {raw} FROM embeddings), f AS (SELECT row_id, "
            + ", ".join(f"{e} AS {n}" for n, e in out.items()) + " FROM c), " + _scaled_sql(["row_id"], list(out), list(out), []))


@register("p_catalogue_segments_embeddings", _segment_sql())
def p_catalogue_segments_embeddings(spark, sf):
    """``embeddings`` as accounts: the first coordinates, as amounts."""
    from riskframe.functions.catalogue import build_segment_set
    em = table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"), *[
        (F.abs(F.col("embedding")[i].cast("double")) * 1000).alias(c) for i, c in enumerate(_SEGMENT_COLS)])
    return round_doubles(build_segment_set(em)[0])
