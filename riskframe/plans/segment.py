"""Customer segmentation composition (C4), Spark-first.

median impute (A10) -> IQR cap, rows kept (A6) -> log1p of skewed columns
(P6) -> ratio features (P16) -> drop correlated (P1) -> robust scale (A12)
-> low-dimensional embedding (C1, PCA in place of a manifold solver) ->
DBSCAN (C2) -> cluster summary (A16), silhouette (A25), Davies-Bouldin
(A26) -> profile on capped, unlogged values (A14) and sizes (A15) -> label
export keeping every source row (S7).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.functions import features as fx
from riskframe.operators import cluster as cl
from riskframe.operators import stats as st
from riskframe.session import checkpoint_dir
from riskframe.sources.sinks import export_labels


@dataclass
class SegmentResult:
    labels: DataFrame          # (id, cluster)
    cap_report: DataFrame      # A6
    summary: DataFrame         # A16 + A25 + A26, one row
    profile: DataFrame         # A14
    sizes: DataFrame           # A15
    export: DataFrame          # S7


def segment(df: DataFrame, id_col: str, impute: list[str], cap: list[str], skewed: list[str],
            ratios: dict[str, tuple[str, str]], drop: list[str], profile_cols: list[str],
            n_components: int = 2, eps: float = 0.3, min_samples: int = 3,
            sample_size: int | None = None) -> SegmentResult:
    spark = df.sparkSession
    checkpoint_dir(spark)
    x = st.median_impute(df, impute).checkpoint(eager=True)     # fitted medians applied once
    capped, report = st.iqr_cap(x, cap)
    capped = capped.checkpoint(eager=True)          # fitted fences applied once
    logged = capped.select(*[fx.log_amount(c).alias(c) if c in skewed else F.col(c) for c in capped.columns])
    feats = logged.select("*", *[fx.safe_ratio(a, b).alias(n) for n, (a, b) in ratios.items()])
    feats = fx.drop_cols(feats, drop)
    cols = [c for c in feats.columns if c != id_col]
    scaled = st.apply_robust_scaler(feats, st.fit_robust_scaler(feats, cols), cols)
    pts = cl.as_points(scaled, id_col, cols).checkpoint(eager=True)     # the model fit reads it several times
    emb = cl.pca_embed(pts, n_components).checkpoint(eager=True)
    labels = cl.dbscan(emb, eps, min_samples).checkpoint(eager=True)
    summary = st.cluster_summary(labels, "cluster")
    sil = cl.silhouette(emb, labels, sample_size)
    n_cl = labels.where("cluster >= 0").select("cluster").distinct().count()
    if n_cl >= 2:
        dbi = cl.davies_bouldin(emb, labels).select("davies_bouldin")
        summary = summary.select("*", sil.select("silhouette").scalar().alias("silhouette"),
                                 dbi.select("davies_bouldin").scalar().alias("davies_bouldin"))
    else:
        summary = summary.select("*", F.lit(None).cast("double").alias("silhouette"),
                                 F.lit(None).cast("double").alias("davies_bouldin"))
    prof_src = capped.join(labels.withColumnRenamed("id", id_col), id_col)
    profile = st.group_profile(prof_src, "cluster", profile_cols)
    sizes = st.group_sizes(prof_src, "cluster")
    export = export_labels(df, labels.withColumnRenamed("id", id_col), id_col, "cluster", "cluster_label")
    return SegmentResult(labels, report, summary, profile, sizes, export)
