"""Classification metrics for many models at once: A17-A23.

Input is the long score table ``(row_id, model, y, score)`` (or any
grouping columns in ``by``).  Ranking metrics come from the per-score
histogram ``(by..., score) -> (pos, neg)`` and the bucketed prefix sum, so
no task ever holds a whole model's scores; threshold metrics are
conditional sums in one aggregate.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.operators.prefix import bucket_index, prefix_sums


def _div0(a: Column, b: Column) -> Column:
    """``a / b`` with 0 for a zero denominator (``zero_division=0``)."""
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


# ---- A17 / A18 / A19 ------------------------------------------------------

def confusion(scores: DataFrame, threshold: float | Column = 0.5, by: list[str] | None = None,
              y: str = "y", score: str = "score", pred: str | None = None) -> DataFrame:
    """A17 + A18: ``(by..., tn, fp, fn, tp, precision, recall, f1, accuracy,
    confusion_matrix [[tn, fp], [fn, tp]])`` at ``score >= threshold``."""
    by = list(by or ["model"])
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    sc = F.col(score).cast("double")
    # Spark orders NaN above every number; a missing score predicts 0
    p = F.col(pred) if pred else F.coalesce((sc >= t) & ~F.isnan(sc), F.lit(False)).cast("int")
    yy = F.col(y)
    agg = scores.groupBy(*by).agg(
        F.sum(((yy == 0) & (p == 0)).cast("int")).cast("bigint").alias("tn"),
        F.sum(((yy == 0) & (p == 1)).cast("int")).cast("bigint").alias("fp"),
        F.sum(((yy == 1) & (p == 0)).cast("int")).cast("bigint").alias("fn"),
        F.sum(((yy == 1) & (p == 1)).cast("int")).cast("bigint").alias("tp"))
    return with_prf(agg)


def with_prf(cm: DataFrame) -> DataFrame:
    """A18 from confusion counts (works on logged matrices too)."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    prec = _div0(tp, tp + fp)
    rec = _div0(tp, tp + fn)
    return cm.select("*", prec.alias("precision"), rec.alias("recall"),
                     _div0(2 * tp, 2 * tp + fp + fn).alias("f1"),
                     _div0(tp + tn, tp + tn + fp + fn).alias("accuracy"),
                     F.array(F.array(tn, fp), F.array(fn, tp)).alias("confusion_matrix"))


def classification_report(scores: DataFrame, threshold: float = 0.5, by: list[str] | None = None,
                          y: str = "y", score: str = "score") -> DataFrame:
    """Per class precision / recall / f1 / support, then accuracy,
    macro and weighted averages, as long rows ``(by..., label, ...)``."""
    by = list(by or ["model"])
    cm = confusion(scores, threshold, by, y, score)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    # class 1 uses (tp, fp, fn); class 0 swaps roles
    p1, r1 = _div0(tp, tp + fp), _div0(tp, tp + fn)
    p0, r0 = _div0(tn, tn + fn), _div0(tn, tn + fp)
    f1_1, f1_0 = _div0(2 * tp, 2 * tp + fp + fn), _div0(2 * tn, 2 * tn + fn + fp)
    s1, s0 = tp + fn, tn + fp
    acc = _div0(tp + tn, n)
    null = F.lit(None).cast("double")

    def row(label, p, r, f, s):
        return F.struct(F.lit(label).alias("label"), p.cast("double").alias("precision"),
                        r.cast("double").alias("recall"), f.cast("double").alias("f1"),
                        s.cast("bigint").alias("support"))
    rows = F.array(
        row("0", p0, r0, f1_0, s0), row("1", p1, r1, f1_1, s1), row("accuracy", null, null, acc, n),
        row("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f1_0 + f1_1) / 2, n),
        row("weighted avg", _div0(p0 * s0 + p1 * s1, n), _div0(r0 * s0 + r1 * s1, n),
            _div0(f1_0 * s0 + f1_1 * s1, n), n))
    return cm.select(*by, F.inline(rows))


# ---- A20 / A21 -------------------------------------------------------------

def score_histogram(scores: DataFrame, by: list[str], y: str = "y", score: str = "score") -> DataFrame:
    """``(by..., score, pos, neg)``, map-side combined; rows without a
    score or label are skipped."""
    ok = F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & F.col(y).isNotNull()
    return scores.where(ok).groupBy(*by, score).agg(
        F.sum(F.col(y).cast("long")).alias("pos"),
        F.sum((1 - F.col(y)).cast("long")).alias("neg"))


def ranking_metrics(scores: DataFrame, by: list[str] | None = None, y: str = "y",
                    score: str = "score", buckets: int | None = None) -> DataFrame:
    """A20 + A21: ``(by..., roc_auc, pr_auc, n_pos, n_neg)``.

    ROC-AUC counts ties as one half: ``sum(pos * (neg_below + neg / 2)) /
    (P N)``.  Average precision is the step sum over distinct thresholds,
    descending: ``sum(pos / P * TP / (TP + FP))`` with ``TP``/``FP`` the
    counts at or above the threshold.  Undefined (one class) -> NULL.
    """
    by = list(by or ["model"])
    hist = score_histogram(scores, by, y, score)
    cum = prefix_sums(hist, score, ["pos", "neg"], by=by, buckets=buckets)
    neg_below = F.col("neg_cum") - F.col("neg")
    tp = F.col("pos_tot") - F.col("pos_cum") + F.col("pos")
    fp = F.col("neg_tot") - F.col("neg_cum") + F.col("neg")
    terms = cum.select(*by, "pos", "pos_tot", "neg_tot",
                       (F.col("pos") * (neg_below + F.col("neg") / 2.0)).alias("_auc"),
                       F.try_divide(F.col("pos") * tp.cast("double"), F.col("pos_tot") * (tp + fp)).alias("_ap"))
    agg = terms.groupBy(*by).agg(F.sum("_auc").alias("_auc"), F.sum("_ap").alias("_ap"),
                                 F.max("pos_tot").alias("n_pos"), F.max("neg_tot").alias("n_neg"))
    return agg.select(*by, F.try_divide(F.col("_auc"), F.col("n_pos") * F.col("n_neg")).alias("roc_auc"),
                      F.when(F.col("n_pos") > 0, F.col("_ap")).alias("pr_auc"),
                      F.col("n_pos").cast("bigint").alias("n_pos"), F.col("n_neg").cast("bigint").alias("n_neg"))


# ---- A22 -------------------------------------------------------------------

def linspace_grid(start: float = 0.01, stop: float = 0.99, n: int = 200) -> list[float]:
    """Evenly spaced thresholds, endpoint exact (``numpy.linspace``)."""
    return [float(x) for x in np.linspace(start, stop, n)]


def step_grid(start: float = 0.1, stop: float = 0.9, step: float = 0.05) -> list[float]:
    """Half-open stepped thresholds (``numpy.arange``: 16 points for the
    default, the 9th being 0.8000000000000002)."""
    return [float(x) for x in np.arange(start, stop, step)]


def threshold_sweep(scores: DataFrame, grid: list[float], by: list[str] | None = None,
                    y: str = "y", score: str = "score") -> DataFrame:
    """A22 table: ``(by..., t_idx, threshold, tp, fp, fn, precision, recall, f1)``
    for every grid point.

    Each row is binned once against the sorted literal grid (binary
    search); bins are counted (grid-sized, map-side combined) and turned
    into ``TP(t) = positives scoring >= t`` by a window over at most
    ``len(grid) + 1`` rows per group.
    """
    by = list(by or ["model"])
    g = sorted(grid)
    garr = F.array(*[F.lit(float(t)) for t in g])
    # j = number of grid points <= score -> predicted positive for t_0..t_{j-1}
    # (Bucketizer: JVM binary search over [-inf, t_0, ..., t_{n-1}, +inf])
    from pyspark.ml.feature import Bucketizer
    bz = Bucketizer(splits=[float("-inf"), *g, float("inf")], inputCol="_s", outputCol="_jd",
                    handleInvalid="keep")
    # a missing score passes no threshold (``NaN >= t`` is false): map it to -inf
    s_ = F.col(score).cast("double")
    binned = bz.transform(scores.withColumn("_s", F.when(s_.isNull() | F.isnan(s_), F.lit(float("-inf")))
                                                  .otherwise(s_)))
    j = F.col("_jd").cast("int")
    bins = binned.groupBy(*by, j.alias("_j")).agg(
        F.sum(F.col(y).cast("long")).alias("_pos"), F.sum((1 - F.col(y)).cast("long")).alias("_neg"))
    totals = bins.groupBy(*by).agg(F.sum("_pos").alias("P"))
    # a bin j counts as predicted positive for thresholds 0..j-1; bins are
    # at most len(grid) + 1 per group, so this stays grid-sized
    pred = (bins.where(F.col("_j") > 0)
            .select(*by, F.explode(F.sequence(F.lit(0), F.col("_j") - 1)).alias("t_idx"), "_pos", "_neg")
            .groupBy(*by, "t_idx").agg(F.sum("_pos").alias("_tp"), F.sum("_neg").alias("_fp")))
    idx = totals.select(*by, "P", F.explode(F.sequence(F.lit(0), F.lit(len(g) - 1))).alias("t_idx"))
    full = idx.join(pred, [*by, "t_idx"], "left")
    tp = F.coalesce(F.col("_tp"), F.lit(0))
    fp = F.coalesce(F.col("_fp"), F.lit(0))
    fn = F.col("P") - tp
    return full.select(*by, "t_idx", garr[F.col("t_idx")].alias("threshold"),
                       tp.cast("bigint").alias("tp"), fp.cast("bigint").alias("fp"), fn.cast("bigint").alias("fn"),
                       _div0(tp, tp + fp).alias("precision"), _div0(tp, tp + fn).alias("recall"),
                       _div0(2 * tp, 2 * tp + fp + fn).alias("f1"))


def best_threshold(sweep: DataFrame, by: list[str] | None = None, default: float | None = None) -> DataFrame:
    """A22 pick: the first grid point with the maximum F1.  With
    ``default`` set, an all-zero F1 keeps ``default`` (the strict ``>``
    update loop starting from 0)."""
    by = list(by or ["model"])
    best = sweep.groupBy(*by).agg(
        F.min_by(F.struct("threshold", "f1"), F.struct((-F.col("f1")).alias("m"), F.col("t_idx"))).alias("_b"))
    thr = F.col("_b.threshold")
    if default is not None:
        thr = F.when(F.col("_b.f1") > 0, thr).otherwise(F.lit(float(default)))
    return best.select(*by, thr.alias("threshold"), F.col("_b.f1").alias("f1"))


# ---- A23 -------------------------------------------------------------------

def evaluate(scores: DataFrame, threshold: float | DataFrame = 0.5, by: list[str] | None = None,
             y: str = "y", score: str = "score", notes: str | Column = "",
             digits: int = 6, with_timestamp: bool = True) -> DataFrame:
    """One results-log record per model: ROC/PR AUC, F1, precision,
    recall (rounded), confusion matrix, threshold, notes, timestamp.

    ``threshold`` is a number or a frame ``(by..., threshold)`` (e.g. from
    :func:`best_threshold`), joined on the (few) model keys.
    """
    by = list(by or ["model"])
    if isinstance(threshold, DataFrame):
        src = scores.join(F.broadcast(threshold.select(*by, "threshold")), by)
        cm = confusion(src, F.col("threshold"), by, y, score)
        thr = threshold.select(*by, "threshold")
    else:
        cm = confusion(scores, threshold, by, y, score)
        thr = None
    rk = ranking_metrics(scores, by, y, score)
    out = cm.join(rk, by)
    if thr is not None:
        out = out.join(thr, by)
    else:
        out = out.withColumn("threshold", F.lit(float(threshold)))
    cols = [*by, F.col("threshold"),
            F.round("roc_auc", digits).alias("ROC_AUC"), F.round("pr_auc", digits).alias("PR_AUC"),
            F.round("f1", digits).alias("F1"), F.round("precision", digits).alias("Precision"),
            F.round("recall", digits).alias("Recall"), F.col("confusion_matrix").alias("Confusion_Matrix"),
            (notes if isinstance(notes, Column) else F.lit(notes)).alias("notes")]
    if with_timestamp:
        cols.append(F.current_timestamp().alias("timestamp"))
    return out.select(*cols)
