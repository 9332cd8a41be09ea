"""Embedding near-duplicates by NN-descent.

1. Equal vectors collapse to one class with a count.
2. Starting lists: the classes are sorted by random-hyperplane signatures
   (``TABLES`` times) and neighbours are searched in runs of ``RUN``.
3. Rounds: around every vector its neighbours and the vectors that list it
   meet and are compared with each other; lists keep the best ``LIST``.
   Rounds end when few lists change.
4. Edges at the threshold, verified in double precision, form components.
5. A vector whose whole list reaches the threshold is saturated: it may have
   links that the list has no room for.  Its list is enlarged by as many
   vectors of other components, found by the same descent among the saturated
   vectors (a link to any other is on that one's list).  What links is one
   component from then on, and whose enlargement is saturated again goes on;
   components only fall in number, so this ends by itself.
6. Within a component every pair of vectors is compared, in blocks of bounded
   size, so all links count, also those on no list.  A component's work is
   quadratic in its different vectors; its memory is two blocks.
7. Audit: all query vectors (ids divisible by 100) are compared with all
   vectors, in blocks; the share of true links that were found is
   ``audit_recall``.  Below ``GOAL`` the descent is repeated from more
   starting lists, and fails when ``TRIES`` of these were not enough.

Lists are of single precision, links of double.  Links below the threshold
never count.

Defined results.  A vector that is null, empty, zero or of another length,
or holds null or non-finite components, links with nothing and is kept.
Repeated rows and rows without an id each get a row; ``component_id`` is the
smallest id of the component (null only if it has none); ids that are not
integers are never queries of the audit.  An empty table
gives an empty result.  Extra columns and labels are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskframe.llm.base import by_group, materialise
from riskframe.llm.graph import components

LIST = 8
REVERSE = 16        # vectors listing a vector that meet around it, the nearest first
TABLES = 6
TRIES = 3
RUN = 256
PER_MEETING = 4     # neighbours that a vector takes from one meeting
BLOCK = 512
SLACK = 1e-5        # rounding of single precision
ROUNDS = 12
CHANGED = 0.02
QUERIES = 4096      # query vectors of a block of the audit
GOAL = 0.95
EDGE = "src long, dst long, sim double"


def matrix(col) -> np.ndarray:
    return np.frombuffer(b"".join(col), dtype="<f8").reshape(len(col), -1)


def unit_vectors(rows: DataFrame, vec_col: str) -> DataFrame:
    """``(rid, vec_id, v)``: unit vectors as bytes, null if not comparable.
    All must have the commonest length; equal vectors give equal bytes."""
    x = F.transform(F.col(vec_col), lambda e: e.cast("double"))
    ok = (F.size(x) > 0) & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & \
        F.exists(x, lambda e: e != 0)
    named = rows.withColumn("x", F.when(ok, x))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for e in b["x"]:
                if e is None:
                    out.append(None)
                    continue
                a = np.asarray(e, dtype="<f8") + 0.0
                a = a / np.abs(a).max()
                out.append((a / np.sqrt((a * a).sum())).tobytes())
            yield pd.DataFrame({"rid": b["rid"], "v": out})
    return named.select("rid", "x").mapInPandas(run, "rid long, v binary")


def floats(col) -> np.ndarray:
    return np.frombuffer(b"".join(col), dtype="<f4").reshape(len(col), -1)


def top(edges: DataFrame) -> DataFrame:
    """The best ``LIST`` distinct neighbours of each source."""
    best = edges.groupBy("src", "dst").agg(F.max("sim").alias("sim"))
    rank = F.row_number().over(W.partitionBy("src").orderBy(F.desc("sim"), "dst"))
    return best.withColumn("r", rank).where(F.col("r") <= LIST).select("src", "dst", "sim")


def best_of(b: pd.DataFrame, k: int, least: np.ndarray | None = None) -> pd.DataFrame:
    """Each vector's ``k`` best among those given of other components."""
    ids, v, comp = b["rid"].to_numpy(), floats(b["f"]), b["comp"].to_numpy()
    s = (v @ v.T).astype(np.float64)
    s[comp[:, None] == comp[None, :]] = -2
    k = min(k, len(ids) - 1)
    near = np.argpartition(-s, k - 1, axis=1)[:, :k]
    sim = np.take_along_axis(s, near, axis=1)
    out = pd.DataFrame({"src": np.repeat(ids, k), "dst": ids[near].ravel(), "sim": sim.ravel()})
    return out[out["sim"].to_numpy() > (-2 if least is None else np.maximum(-2, np.repeat(least, k)))]


def starting_lists(points: DataFrame, n: int, dim: int, tables: range) -> DataFrame:
    bits = max(1, int(np.ceil(np.log2(max(2, n / RUN)))))
    out = None
    for t in tables:
        planes = np.random.default_rng(100 + t).normal(size=(dim, bits + 1))

        def sign(batches: Iterator[pd.DataFrame], planes=planes) -> Iterator[pd.DataFrame]:
            for b in batches:
                p = floats(b["f"]) @ planes if len(b) else np.zeros((0, bits + 1))
                key = ((p[:, :bits] > 0) * (1 << np.arange(bits)[::-1])).sum(1)
                yield pd.DataFrame({"k": key + 1 / (1 + np.exp(-p[:, bits])), "rid": b["rid"], "comp": b["comp"], "f": b["f"]})

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            rest = None
            for b in batches:
                b = b if rest is None else pd.concat([rest, b], ignore_index=True)
                at = 0
                while len(b) - at >= 2 * RUN:
                    yield best_of(b.iloc[at:at + RUN], LIST)
                    at += RUN
                rest = b.iloc[at:]
            while rest is not None and len(rest) > 1:
                yield best_of(rest.iloc[:RUN], LIST)
                rest = rest.iloc[RUN:]
        parts = max(1, n // (16 * RUN))
        keyed = points.select("rid", "comp", "f").mapInPandas(sign, "k double, rid long, comp long, f binary")
        e = keyed.repartitionByRange(parts, "k").sortWithinPartitions("k").mapInPandas(search, EDGE)
        out = e if out is None else out.unionByName(e)
    return top(out)


def meet(lists: DataFrame, points: DataFrame) -> DataFrame:
    """One round: candidates ``(src, dst, sim)`` from all meetings."""
    least = lists.groupBy("src").agg(F.min("sim").alias("least"), F.count(F.lit(1)).alias("k"))
    least = least.select(F.col("src").alias("rid"), F.when(F.col("k") < LIST, F.lit(-2.0)).otherwise(F.col("least")).alias("least"))
    # the nearest of those that list a vector; the rank limit applies before the shuffle too
    rank = F.row_number().over(W.partitionBy("dst").orderBy(F.desc("sim"), "src"))
    back = (lists.withColumn("r", rank).where(F.col("r") <= REVERSE)
            .select(F.col("dst").alias("at"), F.col("src").alias("rid")))
    members = lists.select(F.col("src").alias("at"), F.col("dst").alias("rid")).union(back).distinct()
    vectors = materialise(points.join(least, "rid", "left").select("rid", "comp", "f", F.coalesce("least", F.lit(-2.0)).alias("least")), "knn-vectors")
    full = members.join(vectors, "rid").repartition("at").sortWithinPartitions("at")

    def meeting(pdf: pd.DataFrame) -> pd.DataFrame:
        return best_of(pdf, PER_MEETING, pdf["least"].to_numpy())
    return full.mapInPandas(lambda it: by_group(it, ["at"], meeting), EDGE)


def descend(points: DataFrame, dim: int, tables: range) -> DataFrame:
    """``(src, dst, sim)``: near neighbours of other components for every
    vector of ``points(rid, comp, f)``."""
    n = points.count()
    lists = materialise(starting_lists(points, n, dim, tables), "knn-lists")
    for _ in range(ROUNDS):
        before = lists
        lists = materialise(top(lists.unionByName(meet(lists, points))), "knn-lists")
        changed = lists.join(before.select("src", "dst"), ["src", "dst"], "left_anti").select("src").distinct().count()
        if changed <= CHANGED * n:
            break
    return lists


def verified(lists: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """``(a, b)``: the listed pairs that reach the threshold in double."""
    pairs = (lists.where(F.col("sim") >= threshold - SLACK)
             .select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct())
    both = [reps.select(F.col("rid").alias(k), F.col("v").alias(f"v{k}")) for k in "ab"]

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            if len(x):
                yield x.loc[np.einsum("nd,nd->n", matrix(x["va"]), matrix(x["vb"])) >= threshold, ["a", "b"]]
    return pairs.join(both[0], "a").join(both[1], "b").mapInPandas(test, "a long, b long")


def linked(reps: DataFrame, comp: DataFrame | None, threshold: float, dim: int, tables: range) -> DataFrame:
    """``(rid, comp)`` of every class: components over all links that lists
    and their enlargements find; ``comp`` are those known before."""
    def single(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"rid": b["rid"], "f": [x.tobytes() for x in matrix(b["v"]).astype("<f4")] if len(b) else []})
    f = materialise(reps.select("rid", "v").mapInPandas(single, "rid long, f binary"), "knn-single")
    comp = reps.select("rid", F.col("rid").alias("comp")) if comp is None else comp
    points = f.join(comp, "rid").select("rid", "comp", "f")
    while True:
        lists = descend(materialise(points, "knn-points"), dim, tables)
        edges = materialise(verified(lists, reps, threshold), "knn-edges")
        named = edges.join(comp.select(F.col("rid").alias("a"), F.col("comp").alias("ca")), "a").join(
            comp.select(F.col("rid").alias("b"), F.col("comp").alias("cb")), "b")
        joined = components(named.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).select(
            F.col("v").alias("comp"), F.col("comp").alias("whole"))
        comp = materialise(comp.join(joined, "comp", "left").select("rid", F.coalesce("whole", "comp").alias("comp")), "knn-parts")
        full = (lists.groupBy(F.col("src").alias("rid")).agg(F.count(F.lit(1)).alias("k"), F.min("sim").alias("least"))
                .where((F.col("k") >= LIST) & (F.col("least") >= threshold - SLACK)).select("rid"))
        points = materialise(points.select("rid", "f").join(full, "rid").join(comp, "rid").select("rid", "comp", "f"), "knn-saturated")
        if points.select("comp").distinct().limit(2).count() < 2:
            return comp


def link_counts(comp: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """``(rid, links)``: how many rows of other classes in its component a
    class links with; every pair of a component is compared, by blocks."""
    sizes = materialise(comp.groupBy("comp").agg(F.count(F.lit(1)).alias("m")), "knn-sizes")
    d = (comp.withColumnRenamed("v", "rid").join(sizes, "comp").withColumn("nb", F.ceil(F.col("m") / BLOCK).cast("int"))
         .withColumn("own", F.pmod(F.xxhash64("rid"), F.col("nb")).cast("int"))
         .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
         .select("comp", "rid", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y")))
    full = (d.join(reps.select("rid", "v", "n"), "rid").repartition("comp", "x", "y")
            .sortWithinPartitions("comp", "x", "y"))

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        v, n = matrix(pdf["v"]), pdf["n"].to_numpy(dtype=np.int64)
        near = v @ v.T >= threshold
        np.fill_diagonal(near, False)
        if pdf["x"].iat[0] != pdf["y"].iat[0]:      # pairs within a block belong to its own group
            own = pdf["own"].to_numpy()
            near &= own[:, None] != own[None, :]
        return pd.DataFrame({"rid": pdf["rid"].to_numpy(), "links": near @ n})
    parts = full.mapInPandas(lambda it: by_group(it, ["comp", "x", "y"], count), "rid long, links long")
    return parts.groupBy("rid").agg(F.sum("links").alias("links"))


def audit(named: DataFrame, threshold: float) -> float:
    """Share of the true links of all query vectors that are found, over
    ``named(rid, vec_id, v, comp)``: a link is found if its ends are of one
    component, as all pairs of a component are compared."""
    spark = named.sparkSession
    q = named.where(F.expr("try_cast(vec_id AS bigint) % 100 = 0")).select("rid", "comp", "v")
    n = q.count()
    q = q.withColumn("part", F.pmod(F.xxhash64("rid"), F.lit(max(1, -(-n // QUERIES)))))
    true = found = 0
    for part in range(-(-n // QUERIES)):
        rows = q.where(F.col("part") == part).collect()
        if not rows:
            continue
        shared = spark.sparkContext.broadcast((np.array([r["rid"] for r in rows]), np.array([r["comp"] for r in rows]),
                                               matrix([bytes(r["v"]) for r in rows])))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            rid, c, v = shared.value
            for b in batches:
                for lo in range(0, len(b), BLOCK):
                    x = b.iloc[lo:lo + BLOCK]
                    near = (matrix(x["v"]) @ v.T >= threshold) & (x["rid"].to_numpy()[:, None] != rid[None, :])
                    yield pd.DataFrame({"t": [int(near.sum())], "f": [int((near & (x["comp"].to_numpy()[:, None] == c)).sum())]})
        s = named.select("rid", "v", "comp").mapInPandas(run, "t long, f long").agg(F.sum("t"), F.sum("f")).first()
        true, found = true + (s[0] or 0), found + (s[1] or 0)
    return found / true if true else 1.0


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id",
                    vec_col: str = "embedding") -> DataFrame:
    """``(vec_id, n_links, component_id, kept, audit_recall)`` per row."""
    rows = materialise(vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("x"))
                       .withColumn("rid", F.monotonically_increasing_id()), "knn-rows")
    units = rows.join(unit_vectors(rows, "x"), "rid").select("rid", "vec_id", "v")
    width = units.where("v is not null").groupBy(F.length("v").alias("w")).count().orderBy(F.desc("count"), "w").first()
    dim = width["w"] // 8 if width else 1
    units = materialise(units.withColumn("v", F.when(F.length("v") == 8 * dim, F.col("v"))), "knn-units")
    reps = materialise(units.where("v is not null").groupBy("v").agg(
        F.min("rid").alias("rid"), F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("n")), "knn-classes")
    comp, recall = None, 0.0
    for i in range(TRIES):
        comp = linked(reps, comp, threshold, dim, range(i * TABLES, (i + 1 + i) * TABLES))
        named = materialise(reps.join(comp, "rid"), "knn-named")
        recall = audit(named, threshold)
        if recall >= GOAL:
            break
    else:
        raise RuntimeError(f"recall {recall} of the audited links is below {GOAL}")
    sizes = comp.groupBy("comp").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("comp")
    links = materialise(link_counts(comp.join(sizes, "comp").select(F.col("rid").alias("v"), "comp"), reps, threshold), "knn-links")
    least = materialise(named.groupBy("comp").agg(F.min("vec_id").alias("component_id")), "knn-least")
    classes = named.join(least, "comp").join(links, "rid", "left").select(
        "v", "component_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = units.join(materialise(classes, "knn-result"), "v", "left")
    cid = F.when(F.col("v").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), cid.alias("component_id"),
                      F.col("vec_id").eqNullSafe(cid).alias("kept"), F.lit(float(recall)).alias("audit_recall"))
