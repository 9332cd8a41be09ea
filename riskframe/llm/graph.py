"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.base import materialise


def components(edges: DataFrame) -> DataFrame:
    """``(v, comp)`` for every vertex of ``edges(a, b)``; ``comp`` is the
    smallest vertex of its component.

    Each round every root with a smaller neighbour hooks onto the smallest
    one, the trees are flattened by pointer doubling, and the edges are
    rewritten to roots and deduplicated, so they shrink from round to round.
    Rounds end when no edge is left: nothing is capped.  Every table is
    written to the checkpoint folder, and only row counts reach the driver."""
    e = materialise(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                    .where("a < b").distinct(), "edges")
    label = materialise(e.select(F.col("a").alias("v")).union(e.select("b")).distinct()
                        .select("v", F.col("v").alias("comp")), "labels")
    while e.limit(1).count():
        # a < b: every b hooks onto its smallest neighbour
        parent = materialise(e.groupBy(F.col("b").alias("v")).agg(F.min("a").alias("p")), "parents")
        while True:
            up = parent.select(F.col("v").alias("p"), F.col("p").alias("q"))
            doubled = parent.join(up, "p", "left")
            moved = doubled.select("v", F.coalesce("q", "p").alias("p"), F.col("q").isNotNull().alias("m"))
            moved = materialise(moved, "parents")
            parent = moved.select("v", "p")
            if not moved.where("m").limit(1).count():
                break
        root = parent.select(F.col("v").alias("comp"), F.col("p").alias("r"))
        label = materialise(label.join(root, "comp", "left").select("v", F.coalesce("r", "comp").alias("comp")), "labels")
        ra = parent.select(F.col("v").alias("a"), F.col("p").alias("ra"))
        rb = parent.select(F.col("v").alias("b"), F.col("p").alias("rb"))
        e = (e.join(ra, "a", "left").join(rb, "b", "left")
             .select(F.coalesce("ra", "a").alias("x"), F.coalesce("rb", "b").alias("y")))
        e = materialise(e.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a < b").distinct(), "edges")
    return label
