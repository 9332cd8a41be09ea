"""Running totals over an ordered histogram without a single-task window.

A window ordered over a whole group runs that group in one task.  Instead
the rows are dealt into slices by range of ``(by..., order)`` (Spark samples
the bounds, AQE sets the number of slices by their bytes), whatever the
groups are: a group of a third of all rows spans many slices, small groups
share one.  The sliced table is written once into the checkpoint folder, so
every reader sees the same slices.  Each ``(slice, group)`` part is summed by
an ordinary partitioned window, and the totals of a group's earlier slices
are added back; these totals are at most slices + groups rows and are
written too, so that joining them moves no rows if they are few.

``prefix_sums`` expects one row per ``(by..., order)`` value — a histogram
built with ``groupBy(by..., order).agg(...)`` — so the ``ROWS`` frame equals
a ``RANGE`` frame and ties cannot straddle two slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskframe.session import materialise


def bucket_index(value: Column, splits: Column | list, n_splits: int) -> Column:
    """Number of the sorted ``splits`` strictly below ``value`` (0..n_splits).

    A binary search unrolled into nested CASE WHEN at plan time: log2(n)
    comparisons per row, fully code-generated, no lambda.
    """
    def search(lo: int, hi: int) -> Column:
        if lo >= hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(splits[mid] < value, search(mid + 1, hi)).otherwise(search(lo, mid))
    return search(0, n_splits)


def _ranged(df: DataFrame, keys: list[str], slices: int | None) -> DataFrame:
    return df.repartitionByRange(slices, *keys) if slices else df.repartitionByRange(*keys)


def _with_offsets(rows: DataFrame, tot: DataFrame, by: list[str], totals: list[str]) -> DataFrame:
    """``rows`` with, per ``(slice, group)`` of ``tot``, ``_o_<t>``: the sum
    of ``t`` over the group's earlier slices, and ``_g_<t>``: over all."""
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select(*by, "_slice", *[c for c in tot.columns if c not in (*by, "_slice", *totals)],
                      *[F.coalesce(F.sum(t).over(before), F.lit(0)).alias(f"_o_{t}") for t in totals],
                      *[F.sum(t).over(Window.partitionBy(*by)).alias(f"_g_{t}") for t in totals])
    # null-safe: rows of a NULL group stay
    keys = [*by, "_slice"]
    offs = offs.withColumnsRenamed({c: f"_k{i}" for i, c in enumerate(keys)})
    # written, so that its real size is known: a small one is broadcast and
    # the rows are not shuffled and sorted a second time
    offs = materialise(offs, "slice-offsets")
    return rows.join(offs, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(keys)], "inner")


def prefix_sums(df: DataFrame, order: str, sums: list[str], by: list[str] | None = None,
                buckets: int | None = None, suffix: str = "_cum",
                descending: bool = False) -> DataFrame:
    """Add ``<c>_cum`` = inclusive running total of each column in ``sums``
    over ``order`` (ascending, or descending), within each ``by`` group.

    Also adds ``<c>_tot`` = the group total.  ``df`` is computed once, when
    this is called.  ``buckets`` fixes the number of slices.
    """
    by = list(by or [])
    work = df.withColumn("_ord", -F.col(order) if descending else F.col(order))
    work = materialise(_ranged(work, [*by, "_ord"], buckets).withColumn("_slice", F.spark_partition_id()), "slices")
    w = (Window.partitionBy(*by, "_slice").orderBy("_ord")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    run = work.select("*", *[F.sum(c).over(w).alias(f"_r_{c}") for c in sums])
    tot = work.groupBy(*by, "_slice").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    out = _with_offsets(run, tot, by, [f"_t_{c}" for c in sums])
    return out.select(
        *[F.col(c) for c in df.columns],
        *[(F.col(f"_r_{c}") + F.col(f"_o__t_{c}")).alias(f"{c}{suffix}") for c in sums],
        *[F.col(f"_g__t_{c}").alias(f"{c}_tot") for c in sums],
    )


def row_positions(df: DataFrame, order: list[str], by: list[str] | None = None, name: str = "position",
                  buckets: int | None = None) -> DataFrame:
    """Add ``name``: the row's position (from 0) by ``order`` within its
    ``by`` group.  One shuffle: a sorted slice numbers its own rows, so no
    window is needed.  Rows that tie on all of ``order`` come in any order."""
    by = list(by or [])
    keys = [*by, *order]
    at = F.monotonically_increasing_id()        # partition << 33 | row of the partition
    work = _ranged(df, keys, buckets).sortWithinPartitions(*keys).withColumn("_at", at)
    work = materialise(work.withColumn("_slice", F.shiftright("_at", 33)), "slices")
    tot = work.groupBy(*by, "_slice").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_t"))
    out = _with_offsets(work, tot, by, ["_t"])
    return out.select(*[F.col(c) for c in df.columns], (F.col("_at") - F.col("_first") + F.col("_o__t")).alias(name))
