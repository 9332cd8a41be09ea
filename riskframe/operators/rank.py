"""Ranking and windows: W1 average rank, W3 latest per key, W4 quantile
bins, W5 stratified folds.  W2 (running totals) is in ``prefix``.

None of these uses a window that spans a whole model or class: group-wide
orderings go through the bucketed prefix sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.operators.prefix import bucket_index, prefix_sums, row_positions
from riskframe.operators.quantiles import quantiles
from riskframe.session import materialise

#: A score with at least this share (one in so many) of the rows is ranked without a shuffle.
HOT = 1 << 14


def average_rank(scores: DataFrame, score: str = "score", by: list[str] | None = None,
                 name: str = "rank_pct", per_n: bool = True) -> DataFrame:
    """Ascending rank with ties sharing their mean rank, divided by the
    group size (``rankdata(s) / n``).

    Built from the score histogram: ``rank = below + (ties + 1) / 2`` where
    ``below`` is a bucketed prefix count, then joined back on
    ``(by..., score)``: scores that hold at least ``1 / HOT`` of all rows, so
    at most ``HOT`` of them, are looked up where the rows lie; only rows of
    other scores are shuffled, so a hot score does not fill a task.  Every
    row stays: a NULL score gets a NULL rank, NULL group values are a group.
    """
    by = list(by or [])
    hist = scores.where(F.col(score).isNotNull()).groupBy(*by, score).agg(F.count(F.lit(1)).alias("_n"))
    cum = prefix_sums(hist, score, ["_n"], by=by)
    avg_rank = F.col("_n_cum") - F.col("_n") + (F.col("_n") + 1) / 2.0
    keys = [*by, score]
    r = cum.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], F.col("_n"),
                   (avg_rank / F.col("_n_tot") if per_n else avg_rank).alias(name))
    r = materialise(r, "ranks")
    total = r.agg(F.sum("_n")).first()[0] or 0
    hot = F.col("_n") * F.lit(HOT) >= F.lit(total)
    drop = [f"_k{i}" for i in range(len(keys))]
    same = [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(keys, drop)]
    looked = scores.join(F.broadcast(r.where(hot).drop("_n").withColumn("_hot", F.lit(True))), same, "left").drop(*drop)
    done = F.col("_hot").isNotNull() | F.col(score).isNull()
    rest = looked.where(~done).drop("_hot", name).join(r.where(~hot).drop("_n"), same, "left").drop(*drop)
    return looked.where(done).drop("_hot").unionByName(rest)


def latest_per_key(log: DataFrame, key: list[str], ts: str) -> DataFrame:
    """The most recent record per key of an append-only log.

    A ``max_by`` aggregate (partial aggregation, no per-key sort); ties on
    the timestamp are broken by the full record so the pick is stable.
    """
    from pyspark.sql.types import MapType
    others = [c for c in log.columns if c not in key]
    rec = F.struct(*[F.col(c) for c in others])
    orderable = [F.col(f.name) for f in log.schema.fields
                 if f.name in others and f.name != ts and not isinstance(f.dataType, MapType)]
    out = log.groupBy(*key).agg(F.max_by(rec, F.struct(F.col(ts), *orderable)).alias("_r"))
    return out.select(*key, "_r.*")


def fit_quantile_bins(train: DataFrame, col: str, q: int = 10, method: str = "exact") -> list[float]:
    """W4 fit: the distinct bin edges (of ``q + 1`` quantiles), ascending."""
    found = quantiles(train, [col], [i / q for i in range(q + 1)], method).collect()
    return sorted({e for _, _, e in found if e is not None})


def apply_quantile_bins(df: DataFrame, col: str, edges: list[float], name: str | None = None) -> DataFrame:
    """W4 apply: right-closed bins, lowest edge included, duplicate edges
    dropped (``qcut(..., duplicates="drop")``); outside the edges -> NULL."""
    x = F.col(col).cast("double")
    if edges:
        lits = [F.lit(e) for e in edges]
        code = F.when(x.isNull() | (x < lits[0]) | (x > lits[-1]), F.lit(None)) \
            .otherwise(F.greatest(bucket_index(x, lits, len(edges)) - 1, F.lit(0)))
    else:
        code = F.lit(None)
    return df.withColumn(name or f"{col}_bin", code.cast("int"))


def quantile_bin(df: DataFrame, col: str, q: int = 10, fit_on: DataFrame | None = None,
                 name: str | None = None) -> DataFrame:
    """``fit_on=None`` refits on ``df`` itself (the reference's
    behaviour); pass the training frame to fit once and apply anywhere."""
    fitted = fit_quantile_bins(fit_on if fit_on is not None else df, col, q)
    return apply_quantile_bins(df, col, fitted, name)


def shuffle_key(id_col: str, seed: int) -> Column:
    """A reproducible pseudo-random order: the first 60 bits of
    ``md5(seed || '-' || id)`` (the same order as sorting the md5 text)."""
    h = F.md5(F.concat(F.lit(str(seed)), F.lit("-"), F.col(id_col).cast("string")))
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("bigint")


def stratified_folds(df: DataFrame, y: str, k: int = 5, seed: int = 42, id_col: str = "row_id",
                     name: str = "fold") -> DataFrame:
    """Shuffled k folds that keep each class's share (per class, fold
    sizes differ by at most one).

    Rows are numbered within their class by a seeded hash (ties by id)
    through range slices (no class-wide window); ``fold = position % k``.
    The rows are written once, when this is called.
    """
    keyed = df.withColumn("_h", shuffle_key(id_col, seed))
    ranked = row_positions(keyed, ["_h", id_col], by=[y], name="_row")
    return ranked.withColumn(name, F.pmod("_row", F.lit(k)).cast("int")).drop("_h", "_row")


def fold_split(df: DataFrame, k: int, fold: str = "fold") -> tuple[DataFrame, DataFrame]:
    """``(train = other folds, validation = fold k)``."""
    return df.where(F.col(fold) != k), df.where(F.col(fold) == k)
