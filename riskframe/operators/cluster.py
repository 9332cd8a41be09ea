"""Embedding and density clustering: C1 (PCA), C3 (eps range join), C2
(DBSCAN), A25 (silhouette), A26 (Davies-Bouldin).

Points are ``(id, x array<double>)`` of any dimension d.  DBSCAN and the
range join work on cells of side ``eps / sqrt(d)``: their diameter is at most
``eps``, so every point of a cell is within ``eps`` of every other.  Occupied
cells find their neighbours, in up to 3 dimensions, through a coarse index and
are then compared by the gap between their boxes.  In more dimensions cells are
many, of few points each, and far wider than their points: there points are
compared block by block in tasks (``near_boxes``), which return how many near
points each has, then what joins core cells, but no pairs.  So does the range
join in any dimension, which returns its pairs.  No list of d-dimensional
offsets is formed.  That keeps the work off rows of point pairs:

* equal points are one point with a weight;
* a cell holding ``min_samples`` points makes all of them core, with no
  pair ever formed;
* points of one cell are connected without pairs: a cluster is a graph
  over *cells*, not points;
* distance checks are only formed between points of *different*
  neighbouring cells, and only for points that need them (points of sparse
  cells for counting and borders; core points for links between cells).

Connected components run as min-label propagation with pointer jumping on
the cell graph; each round's labels are written to ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import itertools
import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.operators.blocks import Found, cluster_sums, near_boxes, worst_ratios
from riskframe.operators.farfield import silhouette_parts
from riskframe.operators.prefix import row_positions
from riskframe.session import checkpoint_dir, materialise

# ---- distances ---------------------------------------------------------------


def euclid(a: Column, b: Column) -> Column:
    """Euclidean distance of two ``array<double>`` columns."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda s, v: s + v))


def euclid_d(a: Column, b: Column, d: int) -> Column:
    """Euclidean distance for a known dimension, unrolled at plan time into
    plain arithmetic (code-generated; no lambda per element)."""
    return F.sqrt(sum(((a[i] - b[i]) * (a[i] - b[i]) for i in range(d)), F.lit(0.0)))


def as_points(df: DataFrame, id_col: str, cols: list[str] | None = None, array_col: str | None = None) -> DataFrame:
    """``(id, x array<double>)`` from numeric columns or an array column."""
    if array_col:
        x = F.transform(F.col(array_col), lambda v: v.cast("double"))
    else:
        x = F.array(*[F.col(c).cast("double") for c in cols])
    return df.select(F.col(id_col).alias("id"), x.alias("x"))


# ---- C1 -----------------------------------------------------------------------

def pca_embed(points: DataFrame, k: int, out: str = "x") -> DataFrame:
    """Project ``x`` onto the top-``k`` principal components
    (``ml.feature.PCA``), signs fixed so each component's largest-magnitude
    loading is positive (deterministic up to ties)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array
    vec = points.withColumn("_v", array_to_vector("x"))
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(vec)
    pc = model.pc.toArray()  # d x k, fitted statistics (bounded by d*k)
    signs = [1.0 if pc[abs(pc[:, j]).argmax(), j] >= 0 else -1.0 for j in range(k)]
    proj = model.transform(vec).withColumn("_a", vector_to_array("_p"))
    return proj.select("id", F.array(*[F.col("_a")[j] * F.lit(signs[j]) for j in range(k)]).alias(out),
                       *[c for c in points.columns if c not in ("id", "x")])


# ---- cells ------------------------------------------------------------------------

MARGIN = 1e-9       # floor() may round either way: boxes are taken this much wider
INDEXED = 3         # dimensions that the coarse index is used for, at most


def _dim(points: DataFrame) -> int:
    """The dimension, 0 of an empty frame."""
    row = points.select(F.size("x").alias("d")).first()
    return row.d if row else 0


def _cell(x: Column, d: int, side: float) -> Column:
    return F.array(*[F.floor(x[i] / F.lit(side)).cast("long") for i in range(d)])


def _gap2(a: Column, b: Column, d: int, side: float) -> Column:
    """Squared distance of the nearest corners of two cells."""
    steps = [F.greatest(F.abs(a[i] - b[i]) - 1, F.lit(0)) for i in range(d)]
    return sum((s * s for s in steps), F.lit(0)) * F.lit(side * side)


def _cell_pairs(cells: DataFrame, d: int, eps: float, side: float) -> DataFrame:
    """``(a_..., b_...)``: each unordered pair of different cells of
    ``cells(f, cell, ...)`` whose boxes come within ``eps``, once.

    Cells that near differ by at most ``ceil(sqrt d) + 1`` steps in any
    dimension, so by one step of an index that coarse; of the index's
    neighbours the later half is probed."""
    kept = [c for c in cells.columns if c != "cell"]
    step = math.ceil(math.sqrt(d)) + 1
    at = [F.floor(F.col("cell")[i] / F.lit(float(step))).cast("long") for i in range(d)]
    ahead = [o for o in itertools.product((-1, 0, 1), repeat=d) if o >= (0,) * d]
    offs = F.array(*[F.array(*[F.lit(v) for v in o]) for o in ahead])
    probe = (cells.select("*", F.explode(offs).alias("_o"))
             .select(*[F.col(c).alias(f"a_{c}") for c in [*kept, "cell"]],
                     F.array(*[q + F.col("_o")[k] for k, q in enumerate(at)]).alias("_q"),
                     F.forall("_o", lambda v: v == 0).alias("_own")))
    held = cells.select(*[F.col(c).alias(f"b_{c}") for c in [*kept, "cell"]], F.array(*at).alias("_q"))
    near = _gap2(F.col("a_cell"), F.col("b_cell"), d, side) <= F.lit(eps * eps * (1 + MARGIN))
    met = probe.join(held, "_q").where((~F.col("_own") | (F.col("a_cell") < F.col("b_cell"))) & near)
    return met.drop("_q", "_own", "a_cell", "b_cell")


def _swapped(pairs: DataFrame) -> DataFrame:
    """The pairs in both orders."""
    turn = {c: ("b" if c[0] == "a" else "a") + c[1:] for c in pairs.columns}
    return pairs.unionByName(pairs.select(*[F.col(c).alias(t) for c, t in turn.items()]))


def _side(eps: float, d: int) -> float:
    return eps / math.sqrt(d) * (1 - MARGIN)


# ---- C3 -------------------------------------------------------------------------

def neighbour_pairs(points: DataFrame, eps: float, include_self: bool = False) -> DataFrame:
    """Every unordered pair ``(id_a < id_b)`` within ``eps``, with its
    distance.  Points are compared block by block in tasks, and only the
    pairs found become rows: nothing else grows with them."""
    d = _dim(points)
    none = points.select(F.col("id").alias("id_a"), F.col("id").alias("id_b"), F.lit(0.0).alias("dist"))
    if d == 0:
        return none.limit(0)
    odd = F.coalesce(F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(math.inf))), F.lit(True))
    g = points.select("id", "x", _cell(F.col("x"), d, _side(eps, d)).alias("cell"), odd.alias("odd"))
    g = materialise(g.withColumn("f", F.xxhash64("cell")), "neighbour-points")
    met = near_boxes(g, d, eps, "x", "x", ["id"] if d > INDEXED else ["id", "f"])
    other = F.col("a_id") != F.col("b_id")
    met = met.where(other if d > INDEXED else (F.col("a_f") != F.col("b_f")) | other).select("a_id", "b_id", "dist")
    if g.where("odd").limit(1).count():
        # points with a coordinate that is null or no finite number pair with those of their cell
        pa, pb = (g.select("cell", *[F.col(c).alias(f"{k}_{c}") for c in ("id", "x", "odd")]) for k in "ab")
        met = met.unionByName(pa.where("a_odd").join(pb, "cell").where("a_id != b_id and (not b_odd or a_id < b_id)")
                              .select("a_id", "b_id", euclid_d(F.col("a_x"), F.col("b_x"), d).alias("dist")))
    found = met.select(F.least("a_id", "b_id").alias("id_a"), F.greatest("a_id", "b_id").alias("id_b"), "dist")
    return found.unionByName(none) if include_self else found


# ---- C2 -------------------------------------------------------------------------

class _Degrees(Found):
    """``(id, k)``: the weight of the points near a point of no dense cell,
    those of its own cell left out; a row a point of the task."""

    def __init__(self, keep, one, two):
        super().__init__(keep, one, two)
        self.f, self.w = ([t[c].to_numpy() for t in (one, two)] for c in ("f", "w"))
        self.k = [np.zeros(t.num_rows) for t in (one, two)]

    def wanted(self, i, j):
        return self.f[0][i] != self.f[1][j]

    def add(self, i, j, dist):
        self.k[0] += np.bincount(i, weights=self.w[1][j], minlength=len(self.k[0]))
        self.k[1] += np.bincount(j, weights=self.w[0][i], minlength=len(self.k[1]))
        yield from ()

    def end(self):
        own = self.one is self.two
        for t, k in [(self.one, sum(self.k))] if own else zip((self.one, self.two), self.k):
            at = np.flatnonzero((k > 0) & ~t["dense"].to_numpy())
            yield pa.RecordBatch.from_arrays([t["id"].combine_chunks().take(pa.array(at)), pa.array(k[at].astype(np.int64))], names=["id", "k"])


class _Links(Found):
    """``(id, f, src, dst)``: links between core cells, by their vertex ``v``,
    that join what is joined by the task's pairs, fewer than its cells; and
    each other point with the core cells that it is near."""

    def __init__(self, keep, one, two):
        super().__init__(keep, one, two)
        self.rest, self.f = ([t[c].to_numpy() for t in (one, two)] for c in ("rest", "f"))
        _, self.first, at = np.unique(np.concatenate(self.f), return_index=True, return_inverse=True)
        self.cell = [at[:one.num_rows], at[one.num_rows:]]
        self.root = np.arange(len(self.first))
        self.border: list[list[np.ndarray]] = [[], []]

    def wanted(self, i, j):
        # core points that are joined already need no look
        return self.rest[0][i] | self.rest[1][j] | (self.root[self.cell[0][i]] != self.root[self.cell[1][j]])

    def add(self, i, j, dist):
        for side, (a, b) in enumerate(((i, j), (j, i))):
            on = self.rest[side][a]
            self.border[side].append(np.unique(np.stack([a[on], self.f[1 - side][b[on]]]), axis=1))
        on = ~(self.rest[0][i] | self.rest[1][j])
        a, b = self.cell[0][i[on]], self.cell[1][j[on]]
        while True:
            a, b = self.root[a], self.root[b]
            apart = a != b
            if not apart.any():
                break
            a, b = a[apart], b[apart]
            self.root[np.maximum(a, b)] = np.minimum(a, b)
            while (up := self.root[self.root]).tobytes() != self.root.tobytes():
                self.root = up
        yield from ()

    def end(self):
        ids, links = self.one.schema.field("id").type, self.one.schema.field("v").type
        for t, parts in zip((self.one, self.two), self.border):
            a, f = np.unique(np.concatenate([np.zeros((2, 0), dtype=np.int64), *parts], axis=1), axis=1)
            yield pa.RecordBatch.from_arrays([t["id"].combine_chunks().take(pa.array(a)), pa.array(f), pa.nulls(len(a), links), pa.nulls(len(a), links)],
                                             names=["id", "f", "src", "dst"])
        v = pa.chunked_array([*self.one["v"].chunks, *self.two["v"].chunks], links).combine_chunks()
        at = np.flatnonzero(self.root != np.arange(len(self.root)))
        src, dst = (v.take(pa.array(self.first[x])) for x in (at, self.root[at]))
        yield pa.RecordBatch.from_arrays([pa.nulls(len(at), ids), pa.nulls(len(at), pa.int64()), src, dst], names=["id", "f", "src", "dst"])


def _components(edges: DataFrame, verts: DataFrame) -> DataFrame:
    """Min-label connected components: root hooking plus pointer jumping.

    ``verts``: ``(v)``; ``edges``: ``(src, dst)`` both directions.  Returns
    ``(v, comp)`` with ``comp`` = smallest vertex id of the component.
    Labels only fall, so rounds end by themselves.  Edges are written once
    and labels every round; one row count per round reaches the driver."""
    e = materialise(edges.select("src", "dst"), "component-edges")
    lab = materialise(verts.select("v", F.col("v").alias("comp")), "component-labels")

    def jump(df: DataFrame) -> DataFrame:
        # comp(v) <- comp(comp(v))
        p = df.select(F.col("v").alias("_pv"), F.col("comp").alias("_pc"))
        return (df.join(p, df["comp"] == p["_pv"], "left")
                .select("v", F.least("comp", F.coalesce("_pc", "comp")).alias("comp"), "_old"))

    while True:
        # hook: the smallest neighbouring label goes to the vertex AND to the
        # vertex its current label points to (root hooking), so whole trees
        # merge per round: O(log n) rounds instead of O(diameter)
        nb = e.join(lab.withColumnRenamed("v", "dst"), "dst").groupBy("src").agg(F.min("comp").alias("m"))
        cand = lab.join(nb.withColumnRenamed("src", "v"), "v").where(F.col("m") < F.col("comp"))
        upd = (cand.select(F.explode(F.array("v", "comp")).alias("t"), "m").groupBy("t").agg(F.min("m").alias("mm")))
        hooked = (lab.join(upd.withColumnRenamed("t", "v"), "v", "left")
                  .select("v", F.least("comp", F.coalesce("mm", "comp")).alias("comp"), F.col("comp").alias("_old")))
        nxt = materialise(jump(jump(hooked)), "component-labels")
        lab = nxt.drop("_old")
        if not nxt.where(F.col("comp") != F.col("_old")).limit(1).count():
            return lab


def _core_links(core: DataFrame, pairs: DataFrame, d: int, side: float, eps: float, parts: int) -> DataFrame:
    """``(src, dst)``: pairs of core cells with two core points within eps.

    Every core cell is summarised by its occupied parts (sides of the cell
    cut by ``parts``), each with one of its points.  Two such points within
    eps make a link.  For cell pairs without one, points are compared only
    between parts whose boxes come within eps and that hold other points."""
    sub = side / parts
    inner = core.select("v", "f", "id", "x", _cell(F.col("x"), d, sub).alias("p"))
    summary = inner.groupBy("v", "f", "p").agg(F.min_by("x", "id").alias("x"), F.count(F.lit(1)).alias("n"))
    a, b = (summary.select(*[F.col(c).alias(f"{k}_{c}") for c in summary.columns]) for k in "ab")
    met = pairs.select("a_f", "b_f").join(a, "a_f").join(b, "b_f")
    near = _gap2(F.col("a_p"), F.col("b_p"), d, sub) <= F.lit(eps * eps * (1 + MARGIN))
    sure = euclid_d(F.col("a_x"), F.col("b_x"), d) <= F.lit(eps)
    met = met.select("a_v", "b_v", "a_p", "b_p", sure.alias("sure"), (near & (F.col("a_n") + F.col("b_n") > 2)).alias("open"))
    met = materialise(met.where("sure or open"), "dbscan-parts")
    linked = met.where("sure").select("a_v", "b_v").distinct()
    left = met.where("not sure").join(linked, ["a_v", "b_v"], "left_anti")
    pa, pb = (inner.select(F.col("v").alias(f"{k}_v"), F.col("p").alias(f"{k}_p"), F.col("x").alias(f"{k}_x")) for k in "ab")
    more = (left.join(pa, ["a_v", "a_p"]).join(pb, ["b_v", "b_p"]).where(euclid_d(F.col("a_x"), F.col("b_x"), d) <= F.lit(eps))
            .select("a_v", "b_v").distinct())
    links = linked.unionByName(more)
    return links.select(F.col("a_v").alias("src"), F.col("b_v").alias("dst"))


def dbscan(points: DataFrame, eps: float, min_samples: int, parts: int = 4) -> DataFrame:
    """``(id, cluster)``; ``-1`` = noise.

    Core: at least ``min_samples`` points within ``eps``, the point itself
    included.  Clusters: core points linked through chains of core points
    within ``eps``.  A border point joins the smallest cluster label among
    its core neighbours (deterministic).  Cluster ids are renumbered
    0, 1, ... by each cluster's smallest core id.
    """
    d = _dim(points)
    if d == 0:
        return points.select("id", F.lit(-1).alias("cluster"))
    side = _side(eps, d)
    one = points.groupBy("x").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("w"))
    one = materialise(one.withColumn("cell", _cell(F.col("x"), d, side)), "dbscan-points")
    cells = one.groupBy("cell").agg(F.sum("w").alias("n"))
    # cells go by a number from here on
    cells = cells.select(F.monotonically_increasing_id().alias("f"), "*", (F.col("n") >= min_samples).alias("dense"))
    cells = materialise(cells, "dbscan-cells")

    # a point of a sparse cell counts its own cell and, in neighbouring ones,
    # the points within eps: how many for a dense cell, which ones for a
    # sparse cell, as borders need to know which of those are core
    at = one.join(cells.select("cell", "f", "n", "dense"), "cell")
    kind = points.schema["id"].dataType.simpleString()
    if d > INDEXED:
        # many near points: tasks count them, no pair becomes a row
        degree = near_boxes(at, d, eps, "x", "x", ["id", "f", "w", "dense"], "dense", (_Degrees, f"id {kind}, k bigint"))
        degree = degree.groupBy("id").agg(F.sum("k").alias("k"))
    else:
        pairs = materialise(_cell_pairs(cells.select("cell", "f", "dense"), d, eps, side), "dbscan-pairs")
        sparse = at.where(~F.col("dense"))
        both = _swapped(pairs).where(~F.col("a_dense"))
        a = sparse.select(F.col("f").alias("a_f"), F.col("id").alias("a_id"), F.col("x").alias("a_x"))
        b = at.select(F.col("f").alias("b_f"), F.col("id").alias("b_id"), F.col("x").alias("b_x"), F.col("w").alias("b_w"))
        met = both.join(a, "a_f").join(b, "b_f").where(euclid_d(F.col("a_x"), F.col("b_x"), d) <= F.lit(eps))
        met = met.groupBy("a_id", "b_f", F.when(~F.col("b_dense"), F.col("b_id")).alias("b_id")).agg(F.sum("b_w").alias("n"))
        met = materialise(met, "dbscan-near")
        degree = met.groupBy(F.col("a_id").alias("id")).agg(F.sum("n").alias("k"))
    is_core = F.col("dense") | (F.col("n") + F.coalesce("k", F.lit(0)) >= min_samples)
    pts = materialise(at.join(degree, "id", "left").select("id", "x", "f", is_core.alias("core")), "dbscan-core")

    core = pts.where("core")
    vertex = core.groupBy("f").agg(F.min("id").alias("v"))
    core = core.join(vertex, "f")
    rest = pts.where("not core").select("id", "f")
    if d > INDEXED:
        both = (core.where("v is not null").select("id", "x", "f", "v", F.lit(False).alias("rest"))
                .unionByName(pts.where("not core").select("id", "x", "f", F.lit(None).cast(kind).alias("v"), F.lit(True).alias("rest"))))
        met = materialise(near_boxes(both, d, eps, "x", "x", ["id", "f", "v", "rest"], "rest",
                                     (_Links, f"id {kind}, f bigint, src {kind}, dst {kind}")), "dbscan-near")
        links = met.where("src is not null").select("src", "dst")
        near = met.where("f is not null").select("id", "f")
    else:
        links = _core_links(core, pairs, d, side, eps, parts)
        of_rest = met.join(rest.select(F.col("id").alias("a_id")), "a_id", "left_semi")
        # every point of a dense cell is core
        by_cell = of_rest.where("b_id is null").select(F.col("a_id").alias("id"), F.col("b_f").alias("f"))
        by_point = (of_rest.where("b_id is not null").join(core.select(F.col("id").alias("b_id")), "b_id", "left_semi")
                    .select(F.col("a_id").alias("id"), F.col("b_f").alias("f")))
        near = by_cell.unionByName(by_point)
    edges = links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    comp = _components(edges, vertex.select("v"))

    of_cell = vertex.join(comp, "v").select("f", "comp")
    border = rest.unionByName(near).join(of_cell, "f").groupBy("id").agg(F.min("comp").alias("comp"))
    labelled = core.join(of_cell, "f").select("id", "comp").unionByName(border)

    # renumber clusters 0.. by smallest core id
    ranks = row_positions(comp.select("comp").distinct(), ["comp"], name="cluster")
    named = one.join(labelled.join(ranks, "comp").select("id", "cluster"), "id").select("x", "cluster")
    return points.select("id", "x").join(named, "x", "left").select("id", F.coalesce("cluster", F.lit(-1)).cast("int").alias("cluster"))


# ---- A25 / A26 ----------------------------------------------------------------------

SILHOUETTE_BLOCK = 8192  # points of a chunk and of a block whose distances one task sums
FAR_ROWS = 1 << 15      # above so many points in 1 or 2 dimensions, blocks far apart are not compared point by point


def silhouette(points: DataFrame, labels: DataFrame, sample_size: int | None = None, seed: int = 42,
               label: str = "cluster", block_size: int = SILHOUETTE_BLOCK) -> DataFrame:
    """Mean silhouette over all non-noise points, Euclidean.  One-row
    ``(silhouette, n_sample, n_clusters)``; NULL when fewer than 2 or more
    than n-1 clusters.

    Every pair of point blocks is one task that sums its rows' distances per
    cluster with numpy — no pair rows are formed; the work is quadratic in
    the number of points.  More than ``FAR_ROWS`` points of one or two finite
    numbers are summed by ``farfield``, whose error is that of rounding, with
    equal points as one.  Only if the caller names a ``sample_size``, a
    seeded hash-ordered sample of at most so many points, distances within
    the sample, takes their place, and a column ``share`` tells its share of
    the non-noise points.
    """
    j = points.join(labels.select("id", F.col(label).alias("_l")), "id").where(F.col("_l") != -1)
    j = j.select("id", "x", F.col("_l").cast("int").alias("l"))
    odd = F.coalesce(F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(math.inf))), F.lit(True))
    n, least, most, bad = j.agg(F.count(F.lit(1)), F.min(F.size("x")), F.max(F.size("x")), F.count_if(odd)).first()
    total = n
    if sample_size is None and n > FAR_ROWS and 1 <= least == most <= 2 and not bad:
        points = j.groupBy("l", "x").agg(F.count(F.lit(1)).alias("w"))
        k = j.agg(F.count_distinct("l")).first()[0]
        parts = silhouette_parts(points) if 2 <= k <= n - 1 else None
        if parts is not None:
            return parts.agg((F.sum("s") / F.sum("n")).alias("silhouette"), F.sum("n").alias("n_sample"), F.lit(k).cast("bigint").alias("n_clusters"))
    if sample_size is not None:
        j = (j.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}-"), F.col("id").cast("string"))))
             .orderBy("_h").limit(sample_size).drop("_h"))
        n = min(n, sample_size)
    per = cluster_sums(j, max(1, -(-n // block_size))).groupBy("id", "l").agg(
        F.max(F.when(F.col("cl") == F.col("l"), F.col("n"))).alias("n"),
        F.max(F.when(F.col("cl") == F.col("l"), F.col("s"))).alias("s"),
        F.min(F.when(F.col("cl") != F.col("l"), F.col("s") / F.col("n"))).alias("b"), F.count(F.lit(1)).alias("k"))
    a = F.when(F.col("n") > 1, F.col("s") / (F.col("n") - 1))
    s = F.when(F.col("n") <= 1, F.lit(0.0)).otherwise(
        F.coalesce(F.try_divide(F.col("b") - a, F.greatest(a, F.col("b"))), F.lit(0.0)))     # coincident points: 0
    res = per.select(s.alias("s"), "k")
    out = res.agg(F.avg("s").alias("silhouette"), F.count(F.lit(1)).alias("n_sample"),
                  F.max("k").alias("n_clusters")).select(
        F.when((F.col("n_clusters") >= 2) & (F.col("n_clusters") <= F.col("n_sample") - 1),
               F.col("silhouette")).alias("silhouette"), "n_sample", F.col("n_clusters").cast("bigint"))
    return out if sample_size is None else out.withColumn("share", F.lit(n / total if total else 1.0))


def silhouette_squared(points: DataFrame, labels: DataFrame, label: str = "cluster") -> DataFrame:
    """A25 over squared Euclidean distances, at linear cost: the mean squared
    distance of a point to a cluster follows from the cluster's count, mean
    and mean square.  Same columns as ``silhouette``, all non-noise points;
    it is an index of its own, not an estimate of the other.

    Clusters' statistics go to the tasks in blocks of ``CENTROID_BLOCK``, one
    pass of arithmetic a block over the same rows, all in one stage."""
    j = points.join(labels.select("id", F.col(label).alias("_l")), "id").where(F.col("_l") != -1)
    d = _dim(j)
    j = materialise(j.select("x", F.col("_l").cast("int").alias("l")), "silhouette-points")
    square = sum((F.col("x")[i] * F.col("x")[i] for i in range(d)), F.lit(0.0))
    mean = [F.avg(F.col("x")[i]) for i in range(d)] or [F.lit(0.0)]
    stats = j.groupBy("l").agg(F.count(F.lit(1)).alias("n"), F.array(*mean).alias("c"), F.avg(square).alias("q"))
    stats = materialise(stats, "silhouette-stats")
    k = stats.count()
    if k < 2:
        none = F.lit(None).cast("double").alias("silhouette")
        return j.agg(F.count(F.lit(1)).alias("n_sample")).select(none, "n_sample", F.lit(k).cast("bigint").alias("n_clusters"))
    n_blocks = -(-k // CENTROID_BLOCK)
    out = j.withColumns({"n": F.lit(0).cast("long"), "a": F.lit(0.0), "b": F.lit(float("inf"))})
    schema = out.schema
    for block in range(n_blocks):
        rows = stats.where(F.pmod(F.xxhash64("l"), F.lit(n_blocks)) == block).collect()
        if rows:
            out = out.mapInArrow(partial(_to_clusters, *(np.array([r[f] for r in rows], dtype=t) for f, t in (
                ("l", np.int64), ("n", np.int64), ("c", np.float64), ("q", np.float64)))), schema)
    s = F.when(F.col("n") <= 1, F.lit(0.0)).otherwise(
        F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    res = out.agg(F.avg(s).alias("silhouette"), F.count(F.lit(1)).alias("n_sample"))
    ok = F.lit(k) <= F.col("n_sample") - 1
    return res.select(F.when(ok, F.col("silhouette")).alias("silhouette"), "n_sample", F.lit(k).cast("bigint").alias("n_clusters"))


def _to_clusters(l, n, c, q, batches):
    """Rows ``(x, l, n, a, b)``: the own cluster's count and mean squared
    distance, and the least to another one, brought up to date."""
    for batch in batches:
        if not batch.num_rows:
            continue
        x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        mine, num, a, b = (batch.column(i).to_numpy(zero_copy_only=False).copy() for i in range(1, 5))
        for lo in range(0, len(x), 1024):
            at = slice(lo, lo + 1024)
            # about the centre first: x.x - 2 x.c + q would cancel
            sq = ((x[at, None, :] - c[None]) ** 2).sum(-1) if c.size < 1 << 14 else np.maximum(
                (x[at] ** 2).sum(1)[:, None] - 2 * x[at] @ c.T + (c ** 2).sum(1)[None], 0.0)
            mean = sq + np.maximum(q - (c ** 2).sum(1), 0.0)[None]
            own = mine[at, None] == l[None]
            b[at] = np.minimum(b[at], np.where(own, np.inf, mean).min(axis=1))
            row, col = np.nonzero(own)
            num[lo + row] = n[col]
            a[lo + row] = mean[row, col] * n[col] / np.maximum(n[col] - 1, 1)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(num), pa.array(a), pa.array(b)],
                                         names=batch.schema.names)


CENTROID_BLOCK = 1024       # centroids of a block


def davies_bouldin(points: DataFrame, labels: DataFrame, label: str = "cluster") -> DataFrame:
    """Mean over clusters of ``max_j (s_i + s_j) / d(c_i, c_j)``, all
    non-noise points; ``s_i`` = mean distance to the centroid.

    Centroids and spreads are one row per cluster.  Blocks of at most about
    ``CENTROID_BLOCK`` centroids meet pairwise, each pair a task that keeps
    one maximum a cluster: any number of clusters, quadratic work, bounded
    memory."""
    j = points.join(labels.select("id", F.col(label).alias("_l")), "id").where(F.col("_l") != -1)
    d = _dim(j)
    mean = [F.avg(F.col("x")[i]) for i in range(d)] or [F.lit(0.0)]
    cent = materialise(j.groupBy("_l").agg(F.array(*mean).alias("c")), "centroids")
    spread = (j.join(cent, "_l").groupBy("_l").agg(F.avg(euclid(F.col("x"), F.col("c"))).alias("s")))
    cs = materialise(cent.join(spread, "_l").select(F.col("_l").alias("id"), F.col("c").alias("x"), "s"), "centroids")
    ratios = worst_ratios(cs, max(1, -(-cs.count() // CENTROID_BLOCK)))
    return cs.select("id").join(ratios, "id", "left").agg(
        F.avg("r").alias("davies_bouldin"), F.count(F.lit(1)).alias("n_clusters"))
