"""Robust statistics and profiling: A1-A16, A24, A27, A28, D1, F1, F5, T1-T3.

Fitted operators follow one shape: ``fit_*(df) -> small local frame`` (the
fit runs when it is called) and ``apply_*(df, stats)``, which reads the stats
as literals (columns x a few numbers).  The data side is never joined,
shuffled or broadcast, and a plan does not hold the plans of its fits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskframe.functions.features import clip
from riskframe.operators.quantiles import iqr_fences, local_frame, quantiles, stats_literals
from riskframe.session import materialise


def _stack(wide: DataFrame, cols: list[str], key: str, fields: dict[str, str]) -> DataFrame:
    """Turn one wide row (``<field>__<col>`` columns) into one row per column."""
    rows = F.array(*[F.struct(F.lit(c).alias(key),
                              *[F.col(f"{f}__{c}").cast(t).alias(f) for f, t in fields.items()])
                     for c in cols])
    return wide.select(F.inline(rows))


# ---- A1 / A2 / A13 / F5 ---------------------------------------------------

def shape(df: DataFrame) -> DataFrame:
    """A1: ``(n_rows bigint, n_cols int)``."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(len(df.columns)).alias("n_cols"))


def class_counts(df: DataFrame, y: str) -> DataFrame:
    """A2: ``(n_neg, n_pos, pos_rate, neg_pos_ratio)`` in one hash aggregate."""
    pos = F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).cast("bigint")
    neg = F.sum(F.when(F.col(y) == 0, 1).otherwise(0)).cast("bigint")
    agg = df.agg(neg.alias("n_neg"), pos.alias("n_pos"), F.avg(F.col(y).cast("double")).alias("pos_rate"))
    return agg.select("n_neg", "n_pos", "pos_rate",
                      F.try_divide(F.col("n_neg").cast("double"), F.col("n_pos")).alias("neg_pos_ratio"))


def null_counts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """``(feature, n_null)`` per column plus a ``__total__`` row."""
    cols = cols or df.columns
    wide = df.agg(*[F.sum(F.when(F.col(c).isNull(), 1).otherwise(0)).cast("bigint").alias(f"n_null__{c}")
                    for c in cols])
    long = _stack(wide, cols, "feature", {"n_null": "bigint"})
    total = wide.select(F.lit("__total__").alias("feature"),
                        sum((F.col(f"n_null__{c}") for c in cols), F.lit(0)).cast("bigint").alias("n_null"))
    return long.unionByName(total)


def assert_no_nulls(df: DataFrame, cols: list[str] | None = None) -> None:
    """raise when any cell is NULL (one aggregate job)."""
    row = null_counts(df, cols).where(F.col("feature") == "__total__").first()
    if row and row["n_null"]:
        raise ValueError(f"{row['n_null']} missing values detected")


# ---- A4-A7 outliers -------------------------------------------------------

def outside_fences(x, lower, upper) -> Column:
    """strictly outside; NULL is not an outlier."""
    c = F.col(x) if isinstance(x, str) else x
    return F.coalesce((c < lower) | (c > upper), F.lit(False))


def drop_noise(df: DataFrame, label: str = "cluster") -> DataFrame:
    """keep clustered rows (``label != -1``)."""
    return df.where(F.col(label) != -1)


def outlier_counts(df: DataFrame, cols: list[str], k: float = 1.5, method: str = "exact") -> DataFrame:
    """A5: ``(feature, outlier_count)`` for every column, largest first.

    Fences (A4), then one conditional sum aggregate over all columns.
    """
    fences = iqr_fences(df, cols, k, method)
    s = stats_literals(fences, "feature", ["lower", "upper"], cols)
    wide = df.agg(*[F.sum(outside_fences(c, s[c]["lower"], s[c]["upper"]).cast("int"))
                    .cast("bigint").alias(f"outlier_count__{c}") for c in cols])
    long = _stack(wide, cols, "feature", {"outlier_count": "bigint"})
    return long.select("feature", F.coalesce("outlier_count", F.lit(0)).cast("bigint").alias("outlier_count"))


def sort_desc(df: DataFrame, by: str, tiebreak: list[str] | None = None) -> DataFrame:
    """Order by ``by`` descending, with explicit ascending tie-breakers."""
    return df.orderBy(F.col(by).desc(), *[F.col(t).asc() for t in (tiebreak or [])])


def top_k(df: DataFrame, by: str, k: int, tiebreak: list[str] | None = None) -> DataFrame:
    """First ``k`` rows of T1 (planned as TakeOrderedAndProject)."""
    return sort_desc(df, by, tiebreak).limit(k)


def arg_best(df: DataFrame, metric: str, order: list[str], by: list[str] | None = None,
             maximize: bool = True) -> DataFrame:
    """The first row with the best ``metric`` per ``by`` group; ties go
    to the smallest ``order`` values.  A ``min_by`` aggregate, no sort."""
    by = by or []
    others = [c for c in df.columns if c not in by]
    m = -F.col(metric) if maximize else F.col(metric)
    key = F.struct(m.alias("m"), *[F.col(o) for o in order])
    best = df.groupBy(*by).agg(F.min_by(F.struct(*[F.col(c) for c in others]), key).alias("_b"))
    return best.select(*by, "_b.*")


def iqr_cap(df: DataFrame, cols: list[str], k: float = 1.5,
            method: str = "exact") -> tuple[DataFrame, DataFrame]:
    """``(capped_df, report)``; rows are never dropped.

    ``report``: ``(feature, capped_low, capped_high, total_capped)``.  Each
    column's fence uses only that column, so one pass equals the loop.
    """
    fences = iqr_fences(df, cols, k, method)
    s = stats_literals(fences, "feature", ["lower", "upper"], cols)
    capped = df.select(*[clip(c, s[c]["lower"], s[c]["upper"]).alias(c) if c in cols else F.col(c)
                         for c in df.columns])
    aggs = []
    for c in cols:
        aggs.append(F.sum(F.when(F.col(c) < s[c]["lower"], 1).otherwise(0)).cast("bigint").alias(f"capped_low__{c}"))
        aggs.append(F.sum(F.when(F.col(c) > s[c]["upper"], 1).otherwise(0)).cast("bigint").alias(f"capped_high__{c}"))
    wide = df.agg(*aggs)
    long = _stack(wide, cols, "feature", {"capped_low": "bigint", "capped_high": "bigint"})
    report = long.select("feature", "capped_low", "capped_high",
                         (F.col("capped_low") + F.col("capped_high")).alias("total_capped"))
    return capped, report


def iqr_drop(df: DataFrame, cols: list[str], k: float = 1.5, method: str = "exact") -> DataFrame:
    """Keep rows inside every fence (NULL cells are kept)."""
    fences = iqr_fences(df, cols, k, method)
    s = stats_literals(fences, "feature", ["lower", "upper"], cols)
    cond = F.lit(True)
    for c in cols:
        cond = cond & ~outside_fences(c, s[c]["lower"], s[c]["upper"])
    return df.where(cond)


def coverage_compare(df: DataFrame, cols: list[str], k: float = 1.5, method: str = "exact",
                     score_drop: Column | float | None = None,
                     score_cap: Column | float | None = None) -> DataFrame:
    """Rows used and coverage of the drop (A7) and cap (A6) approaches.

    ``(approach, rows_used, total_rows, coverage_pct, score, delta_pct)``;
    scores are optional inputs (e.g. a silhouette) and ``delta_pct`` is the
    cap score's change relative to the drop score.
    """
    fences = iqr_fences(df, cols, k, method)
    s = stats_literals(fences, "feature", ["lower", "upper"], cols)
    inside = F.lit(True)
    for c in cols:
        inside = inside & ~outside_fences(c, s[c]["lower"], s[c]["upper"])
    agg = df.agg(F.count(F.lit(1)).alias("total_rows"),
                 F.sum(inside.cast("int")).cast("bigint").alias("kept"))
    sd = F.lit(None).cast("double") if score_drop is None else (
        score_drop if isinstance(score_drop, Column) else F.lit(float(score_drop)))
    sc = F.lit(None).cast("double") if score_cap is None else (
        score_cap if isinstance(score_cap, Column) else F.lit(float(score_cap)))
    rows = F.array(
        F.struct(F.lit("drop").alias("approach"), F.col("kept").alias("rows_used"), sd.alias("score")),
        F.struct(F.lit("cap").alias("approach"), F.col("total_rows").alias("rows_used"), sc.alias("score")))
    out = agg.select("total_rows", F.inline(rows), sd.alias("_sd"))
    return out.select(
        "approach", "rows_used", "total_rows",
        (F.col("rows_used") * 100.0 / F.col("total_rows")).alias("coverage_pct"),
        "score",
        F.when(F.col("approach") == "cap",
               F.try_divide((F.col("score") - F.col("_sd")) * 100.0, F.col("_sd"))).alias("delta_pct"))


# ---- A9-A12 fitted transforms ---------------------------------------------

def fit_quantile_cap(train: DataFrame, cols: list[str], p: float = 0.999,
                     method: str = "exact") -> DataFrame:
    """A9 fit: ``(feature, cap)`` = the p-quantile learned on ``train``."""
    rows = [(f, q) for f, _, q in quantiles(train, cols, [p], method).collect()]
    return local_frame(train.sparkSession, rows, [("feature", "string"), ("cap", "double")])


def apply_quantile_cap(df: DataFrame, caps: DataFrame, cols: list[str]) -> DataFrame:
    """A9 apply: upper-clip each column at its learned cap (train or test)."""
    s = stats_literals(caps, "feature", ["cap"], cols)
    return df.select(*[clip(c, hi=s[c]["cap"]).alias(c) if c in cols else F.col(c) for c in df.columns])


def median_impute(df: DataFrame, cols: list[str], method: str = "exact") -> DataFrame:
    """A10: fill NULL by the column's exact median."""
    med = quantiles(df, cols, [0.5], method).select("feature", F.col("q").alias("median"))
    s = stats_literals(med, "feature", ["median"], cols)
    return df.select(*[F.coalesce(F.col(c), s[c]["median"].cast(df.schema[c].dataType)).alias(c)
                       if c in cols else F.col(c) for c in df.columns])


def zscore(df: DataFrame, col: str, name: str | None = None, eps: float = 1e-8) -> DataFrame:
    """``(x - mean) / (sample std + eps)`` with the frame's own stats."""
    return apply_zscore(df, col, fit_zscore(df, col), name, eps)


def fit_zscore(train: DataFrame, col: str) -> DataFrame:
    """A11 fit: ``(feature, mu, sd)``."""
    mu, sd = train.agg(F.avg(col).cast("double"), F.stddev_samp(col).cast("double")).first()
    return local_frame(train.sparkSession, [(col, mu, sd)], [("feature", "string"), ("mu", "double"), ("sd", "double")])


def zscore_of(col: str, fitted: DataFrame, eps: float = 1e-8) -> Column:
    s = stats_literals(fitted, "feature", ["mu", "sd"], [col])[col]
    return (F.col(col) - s["mu"]) / (s["sd"] + F.lit(eps))


def apply_zscore(df: DataFrame, col: str, fitted: DataFrame, name: str | None = None, eps: float = 1e-8) -> DataFrame:
    """A11 apply, to the training frame or any other."""
    return df.withColumn(name or f"{col}_zscore", zscore_of(col, fitted, eps))


def fit_robust_scaler(train: DataFrame, cols: list[str], method: str = "exact") -> DataFrame:
    """A12 fit: ``(feature, median, iqr)``."""
    got = {(f, p): q for f, p, q in quantiles(train, cols, [0.25, 0.5, 0.75], method).collect()}
    rows = [(c, got[c, 0.5], None if got[c, 0.5] is None else got[c, 0.75] - got[c, 0.25]) for c in dict.fromkeys(cols)]
    return local_frame(train.sparkSession, rows, [("feature", "string"), ("median", "double"), ("iqr", "double")])


def apply_robust_scaler(df: DataFrame, scaler: DataFrame, cols: list[str]) -> DataFrame:
    """A12 apply: ``(x - median) / iqr``; an IQR of 0 divides by 1."""
    s = stats_literals(scaler, "feature", ["median", "iqr"], cols)
    def scaled(c):
        iqr = s[c]["iqr"]
        return ((F.col(c) - s[c]["median"]) / F.when(iqr == 0, F.lit(1.0)).otherwise(iqr)).alias(c)
    return df.select(*[scaled(c) if c in cols else F.col(c) for c in df.columns])


# ---- A14-A16, A24 ---------------------------------------------------------

def group_profile(df: DataFrame, key: str, cols: list[str], digits: int = 2,
                  exclude_noise: bool = True) -> DataFrame:
    """Per-group means rounded half-to-even (``bround``)."""
    src = df.where(F.col(key) >= 0) if exclude_noise else df
    return src.groupBy(key).agg(*[F.bround(F.avg(c), digits).alias(c) for c in cols])


def group_sizes(df: DataFrame, key: str, exclude_noise: bool = True) -> DataFrame:
    """``(key, n, share_pct)``; the share's base counts every row."""
    total = df.agg(F.count(F.lit(1))).scalar()
    src = df.where(F.col(key) >= 0) if exclude_noise else df
    return (src.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
            .select(key, "n", (F.col("n") * 100.0 / total).alias("share_pct")))


def cluster_summary(df: DataFrame, label: str) -> DataFrame:
    """``(n_clusters, n_noise, noise_pct, n_rows)``."""
    return df.agg(
        F.count_distinct(F.when(F.col(label) != -1, F.col(label))).alias("n_clusters"),
        F.sum(F.when(F.col(label) == -1, 1).otherwise(0)).cast("bigint").alias("n_noise"),
        F.count(F.lit(1)).alias("n_rows"),
    ).select("n_clusters", "n_noise", (F.col("n_noise") * 100.0 / F.col("n_rows")).alias("noise_pct"), "n_rows")


def score_spread(df: DataFrame, metric: str, by: list[str] | None = None) -> DataFrame:
    """Min, max, population std (and mean) of a metric."""
    return df.groupBy(*(by or [])).agg(
        F.min(metric).alias("min"), F.max(metric).alias("max"),
        F.stddev_pop(metric).alias("std_pop"), F.avg(metric).alias("mean"),
        F.count(F.lit(1)).alias("n"))


# ---- A27 / A28 / D1 -------------------------------------------------------

def boxplot_stats(df: DataFrame, cols: list[str], k: float = 1.5, method: str = "exact") -> DataFrame:
    """Five-number summary plus whiskers (extreme points inside the
    fences) and outlier count, one row per column."""
    got = {(f, p): q for f, p, q in quantiles(df, cols, [0.25, 0.5, 0.75], method).collect()}
    rows = []
    for c in dict.fromkeys(cols):
        q1, med, q3 = (got[c, p] for p in (0.25, 0.5, 0.75))
        rows.append((c, q1, med, q3, q1 - k * (q3 - q1), q3 + k * (q3 - q1)) if q1 is not None else (c, *[None] * 5))
    five = local_frame(df.sparkSession, rows, [("feature", "string"), *[
        (n, "double") for n in ("q1", "median", "q3", "lower", "upper")]])
    s = stats_literals(five, "feature", ["lower", "upper"], cols)
    aggs = []
    for c in cols:
        inside = (F.col(c) >= s[c]["lower"]) & (F.col(c) <= s[c]["upper"])
        aggs += [F.min(c).cast("double").alias(f"min__{c}"), F.max(c).cast("double").alias(f"max__{c}"),
                 F.min(F.when(inside, F.col(c))).cast("double").alias(f"whisker_low__{c}"),
                 F.max(F.when(inside, F.col(c))).cast("double").alias(f"whisker_high__{c}"),
                 F.sum(outside_fences(c, s[c]["lower"], s[c]["upper"]).cast("int")).cast("bigint").alias(f"n_outliers__{c}")]
    wide = df.agg(*aggs)
    long = _stack(wide, cols, "feature", {"min": "double", "max": "double", "whisker_low": "double",
                                         "whisker_high": "double", "n_outliers": "bigint"})
    return long.join(five, "feature").select("feature", "min", "q1", "median", "q3", "max",
                                            "whisker_low", "whisker_high", "n_outliers")


def best_iteration(curve: DataFrame, iter_col: str, metric: str, by: list[str] | None = None,
                   maximize: bool = True) -> DataFrame:
    """First best iteration, last iteration and patience per run.

    ``(by..., best_iter, best_value, last_iter, patience)`` where patience =
    last - best (the early-stopping rule the trainer applied).
    """
    by = by or []
    m = F.col(metric) if maximize else -F.col(metric)
    key = F.struct(m.alias("m"), (-F.col(iter_col)).alias("i"))
    out = curve.groupBy(*by).agg(
        F.max_by(F.struct(F.col(iter_col).alias("it"), F.col(metric).alias("v")), key).alias("_b"),
        F.max(iter_col).alias("last_iter"))
    return out.select(*by, F.col("_b.it").alias("best_iter"), F.col("_b.v").alias("best_value"),
                      "last_iter", (F.col("last_iter") - F.col("_b.it")).alias("patience"))


def dedupe(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(distinct rows, one-row frame with n_before, n_after, n_removed)``."""
    out = df.dropDuplicates()
    n_before = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    report = out.agg(F.count(F.lit(1)).alias("n_after")).select(
        n_before.alias("n_before"), "n_after", (n_before - F.col("n_after")).alias("n_removed"))
    return out, report


# ---- P19 / P20 weights ----------------------------------------------------

def with_class_weight(df: DataFrame, y: str, name: str = "weight") -> DataFrame:
    """``neg/pos`` on positive rows, 1.0 elsewhere (ratio from A2)."""
    ratio = class_counts(df, y).select("neg_pos_ratio").first()[0]
    return df.withColumn(name, F.when(F.col(y) == 1, F.lit(ratio).cast("double")).otherwise(F.lit(1.0)))


def with_balanced_weight(df: DataFrame, y: str, name: str = "weight") -> DataFrame:
    """P20: ``n / (k * n_class)`` (the ``balanced`` rule).

    Class counts are map-side combined and written out (one row a class, any
    number of classes), so the join sees their real size.  Rows without a
    label count in no class and get a NULL weight.
    """
    counts = df.where(F.col(y).isNotNull()).groupBy(F.col(y).alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
    counts = materialise(counts, "class-counts")
    n, k = counts.agg(F.sum("_n"), F.count(F.lit(1))).first()
    w = counts.select("_c", (F.lit(n).cast("double") / (F.lit(k) * F.col("_n"))).alias(name))
    return df.drop(name).join(w, F.col(y) == F.col("_c"), "left").drop("_c")
