"""Resampling: exact k-nearest neighbours by pivots, R1 SMOTE, R2 Tomek links.

kNN never materialises pair rows.  Points are dealt to the nearest of some
pivots (Voronoi cells), large cells into blocks.  Every point first searches
the block it lies in, which bounds the distance of its k-th neighbour; by the
triangle inequality only cells that the bound reaches can hold nearer ones,
and only to those is it copied.  The search is exact in any dimension; how
far the bound prunes depends on the data, and in many dimensions it may reach
most cells.  Memory per task is bounded by ``block_size``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.operators.blocks import id_type_of, pivot_distances, topk_cogroup
from riskframe.operators.prefix import row_positions
from riskframe.session import materialise

BLOCK_SIZE = 4_096
#: Copies of a query that the second search makes on average before it takes wider blocks, at least.
SPREAD = 24
#: Bytes of a wide block's vectors, at most about; rows that a task copies at a time.
WIDE_BYTES, REACHED = 1 << 25, 1 << 17
#: Pivots at most: a matrix of so many points goes to every task.
PIVOTS = 512


def _with_cell(points: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``points`` with the nearest pivot's number and distance."""
    schema = points.select("*", F.lit(0).alias("cell"), F.lit(0.0).alias("away")).schema
    at = points.columns.index("x")

    def run(batches):
        for b in batches:
            if b.num_rows:
                d = pivot_distances(_matrix(b.column(at)), pivots)
                cell = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(d.min(axis=1))],
                                                 names=[*b.schema.names, "cell", "away"])
    return points.mapInArrow(run, schema)


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _reached(found: DataFrame, pivots: np.ndarray, radius: dict[int, float], blocks: dict[int, int],
             first: dict[int, int] | None = None, counted: bool = False) -> DataFrame:
    """``(x, within, cell, block)``: the blocks, but the own one, that can
    hold a point nearer than ``kth``.  A point of cell j is at least
    ``d(q, p_j) - radius_j`` away, and at least half of what p_j is farther
    than the own pivot.

    With ``first``, cell j lies in the ``blocks[j]`` wide blocks from
    ``first[j]`` on: ``cell`` is a wide block's number, each once, the own one
    included.  ``counted`` gives ``(cell, n)`` in place of the rows."""
    r = np.array([radius.get(j, -np.inf) for j in range(len(pivots))])
    parts = np.array([blocks.get(j, 0) for j in range(len(pivots))], dtype=np.int64)
    start = None if first is None else np.array([first.get(j, 0) for j in range(len(pivots))], dtype=np.int64)
    step = max(1, REACHED // max(1, int(parts.sum())))      # copies of a piece are bounded

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, step):
                x, own, block, kth = (b.column(i).slice(lo, step) for i in range(4))
                own = own.to_numpy()
                d = pivot_distances(_matrix(x), pivots)
                home = d[np.arange(len(d)), own]
                least = np.maximum(d - r[None], (d - home[:, None]) / 2)
                row, cell = np.nonzero(least <= kth.to_numpy()[:, None] * (1 + 1e-9))
                n = parts[cell]
                row, cell = np.repeat(row, n), np.repeat(cell, n)
                part = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                if start is None:
                    other = (cell != own[row]) | (part != block.to_numpy()[row])
                    row, cell, part = row[other], cell[other], part[other]
                else:
                    both = np.unique(np.stack([row, start[cell] + part]), axis=1)
                    row, cell, part = both[0], both[1], np.zeros(both.shape[1], dtype=np.int64)
                if counted:
                    cell, n = np.unique(cell, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(n.astype(np.int64))], names=["cell", "n"])
                else:
                    row = pa.array(row)
                    yield pa.RecordBatch.from_arrays([x.take(row), kth.take(row), pa.array(cell.astype(np.int32)),
                                                      pa.array(part.astype(np.int32))], names=["x", "within", "cell", "block"])
    return found.select("x", "cell", "block", "kth").mapInArrow(
        run, "cell int, n long" if counted else "x array<double>, within double, cell int, block int")


def _reach_counts(*args) -> dict[int, int]:
    """Rows of ``_reached`` a cell (or wide block)."""
    return {r.cell: r.n for r in _reached(*args, counted=True).groupBy("cell").agg(F.sum("n").alias("n")).collect()}


def _wide(sizes: dict[int, int], rows: int) -> tuple[dict[int, int], dict[int, int]]:
    """``(first, parts)``: small cells are put together into wide blocks of
    at most ``rows`` points, larger ones are cut."""
    first, parts, at, held = {}, {}, 0, 0
    for c, n in sorted(sizes.items()):
        if held and held + n > rows:
            at, held = at + 1, 0
        first[c], parts[c] = at, math.ceil(n / rows)
        held += n
        if n > rows:
            at, held = at + parts[c], 0
    return first, parts


def _number(of: dict[int, int]) -> Column:
    """The number that ``of`` has for the row's cell (at most one a pivot)."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in of.items() for v in kv]), F.col("cell")), F.lit(1)) \
        if of else F.lit(1)


def _counts(df: DataFrame) -> dict[int, int]:
    return {r.cell: r.n for r in df.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}


def _met(query: DataFrame, cand: DataFrame, chunks: dict[int, int], k: int, itype: str) -> DataFrame:
    """``topk_cogroup`` over blocks, their queries dealt into bounded chunks."""
    n = _number(chunks)
    q = query.withColumn("chunk", F.pmod(F.xxhash64(F.lit(5), "x"), n).cast("int"))
    c = cand.withColumn("chunk", F.explode(F.sequence(F.lit(0), n - 1)))
    return topk_cogroup(q, c, ["cell", "block", "chunk"], k, itype)


def knn(query: DataFrame, candidates: DataFrame, k: int, exclude_self: bool = True,
        block_size: int = BLOCK_SIZE, query_chunk: int = BLOCK_SIZE) -> DataFrame:
    """Exact k nearest candidates of every query point.

    ``query``/``candidates``: ``(id, x array<double>)``.  Returns ``(id, nn
    array<struct<dist double, nid>>)`` sorted by distance, ties by id.

    Equal points are searched once, and stand for their ``k + 1`` smallest
    ids: no more of them can be among anyone's neighbours."""
    itype, most = id_type_of(candidates), k + 1
    first = row_positions(candidates.select("id", "x"), ["id"], ["x"], "_p").where(F.col("_p") < most)
    cand = materialise(first.groupBy("x").agg(F.sort_array(F.collect_list("id")).alias("ids")), "knn-candidates")
    n = cand.count()
    if n == 0:
        none = F.expr("array()").cast(f"array<struct<dist:double,nid:{itype}>>")
        return query.select("id", none.alias("nn"))
    some = cand.orderBy(F.xxhash64("x"), "x").limit(min(PIVOTS, math.ceil(n / block_size))).select("x").collect()
    pivots = np.array([r.x for r in some], dtype=np.float64)
    cand = materialise(_with_cell(cand, pivots), "knn-candidates")
    asked = materialise(_with_cell(query.select("x").distinct(), pivots), "knn-queries")
    stats = cand.groupBy("cell").agg(F.max("away").alias("r"), F.count(F.lit(1)).alias("n")).collect()
    radius, blocks = {s.cell: s.r for s in stats}, {s.cell: math.ceil(s.n / block_size) for s in stats}
    block = F.pmod(F.xxhash64(F.lit(3), "x"), _number(blocks)).cast("int").alias("block")
    held = cand.select("cell", block, F.col("x").alias("cx"), "ids")

    own = asked.select("x", "cell", block, F.lit(float("inf")).alias("within"))
    chunks = {c: math.ceil(m / (blocks[c] * query_chunk)) for c, m in _counts(asked).items()}
    near = _met(own, held, chunks, most, itype)
    near = materialise(near, "knn-own")
    # a first pass only counts the copies; many go straight into the shuffle
    own = own.drop("within").join(near.select("x", "kth"), "x")
    met = _reach_counts(own, pivots, radius, blocks)
    found = near.select("x", "nn")
    rows = max(block_size, min(math.ceil(n / SPREAD), WIDE_BYTES // (8 * max(1, pivots.shape[1]))))
    if sum(met.values()) > SPREAD * near.count() and rows > block_size:
        # the bound leaves out little: the same search over fewer, wider blocks, the own ones again among them
        first, parts = _wide({s.cell: s.n for s in stats}, rows)
        met = _reach_counts(own, pivots, radius, parts, first)
        reached = _reached(own, pivots, radius, parts, first)
        group = _number(first) + F.pmod(F.xxhash64(F.lit(3), "x"), _number(parts))
        held = cand.select(group.cast("int").alias("cell"), F.lit(0).alias("block"), F.col("x").alias("cx"), "ids")
        chunks = {g: math.ceil(m / max(query_chunk, rows)) for g, m in met.items()}
        found = found.limit(0)
    else:
        reached = materialise(_reached(own, pivots, radius, blocks), "knn-reached")
        chunks = {c: math.ceil(m / (blocks[c] * query_chunk)) for c, m in met.items()}
    far = _met(reached, held, chunks, most, itype)

    pairs = F.flatten(F.transform(F.flatten(F.collect_list("nn")), lambda e: F.transform(
        e["ids"], lambda i: F.struct(e["dist"].alias("dist"), i.alias("nid")))))
    best = found.unionByName(far.where(F.size("nn") > 0).select("x", "nn")).groupBy("x").agg(
        F.slice(F.array_sort(pairs), 1, most).alias("nn"))
    out = query.select("id", "x").join(best, "x")
    others = F.filter("nn", lambda e: e["nid"] != F.col("id")) if exclude_self else F.col("nn")
    return out.select("id", F.slice(others, 1, k).alias("nn"))


# ---- R1 SMOTE -------------------------------------------------------------------

def _hash52(seed: int, *cols: Column) -> Column:
    """A seeded 52-bit hash (MD5 of ``seed-col-col``), the same in any SQL
    engine."""
    key = F.concat_ws("-", F.lit(str(seed)), *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("bigint")


def smote(df: DataFrame, y: str = "y", id_col: str = "row_id", features: list[str] | None = None,
          k: int = 5, seed: int = 42, minority: int = 1, block_size: int = BLOCK_SIZE) -> DataFrame:
    """Append synthetic minority rows until both classes are equal.

    Each synthetic row lies on the segment from a minority point to one of
    its ``k`` nearest minority neighbours: ``x + u * (nn - x)``.  Copies are
    spread evenly over minority points (``S // m`` each, one more for the
    first ``S % m`` in a seeded hash order); neighbour and ``u`` come from
    seeded hashes, so the output is reproducible.  Output columns:
    ``(id_col, y, features..., synthetic int)``; synthetic ids are
    ``"<id>#<copy>"`` strings.
    """
    features = features or [c for c in df.columns if c not in (y, id_col)]
    base = df.select(F.col(id_col).cast("string").alias("id"), F.col(y).alias("_y"),
                     F.array(*[F.col(c).cast("double") for c in features]).alias("x"))
    counts = {r["_y"]: r["n"] for r in base.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    m = counts.get(minority, 0)
    n_major = max(v for c, v in counts.items() if c != minority) if len(counts) > 1 else 0
    S = n_major - m
    orig = base.select(F.col("id").alias(id_col), F.col("_y").alias(y),
                       *[F.col("x")[i].alias(c) for i, c in enumerate(features)], F.lit(0).alias("synthetic"))
    if S <= 0:
        return orig
    if m < 2:
        raise ValueError(f"SMOTE needs two minority rows, found {m}")
    mino = base.where(F.col("_y") == minority).select("id", "x")
    nn = knn(mino, mino, k, True, block_size)
    per, extra = divmod(S, m)
    h = mino.withColumn("_h", _hash52(seed, F.col("id")))
    ranked = row_positions(h, ["_h", "id"], name="_r").select("id", "x", "_r")
    copies = F.lit(per) + F.when(F.col("_r") < extra, 1).otherwise(0)
    rows = (ranked.join(nn, "id").where(F.size("nn") > 0)
            .select("id", "x", "nn", F.explode(F.sequence(F.lit(0), copies - 1)).alias("_c")))
    pick = (_hash52(seed, F.col("id"), F.col("_c")) % F.size("nn")).cast("int")
    u = _hash52(seed + 1, F.col("id"), F.col("_c")).cast("double") / F.lit(float(1 << 52))
    nbr = F.col("nn")[pick]["nid"]
    rows = rows.select("id", "x", "_c", nbr.alias("_nid"), u.alias("_u"))
    nx = mino.select(F.col("id").alias("_nid"), F.col("x").alias("_nx"))
    syn = rows.join(nx, "_nid").select(
        F.concat(F.col("id"), F.lit("#"), F.col("_c").cast("string")).alias(id_col), F.lit(minority).alias(y),
        F.zip_with("x", "_nx", lambda a, b: a + F.col("_u") * (b - a)).alias("_x"))
    syn = syn.select(id_col, y, *[F.col("_x")[i].alias(c) for i, c in enumerate(features)],
                     F.lit(1).alias("synthetic"))
    return orig.unionByName(syn)


# ---- R2 Tomek links ---------------------------------------------------------------

def tomek_links(df: DataFrame, y: str = "y", id_col: str = "row_id", features: list[str] | None = None,
                block_size: int = BLOCK_SIZE) -> DataFrame:
    """R2 detection: pairs ``(id_a < id_b)`` of opposite class that are each
    other's nearest neighbour (ties: smaller id)."""
    features = features or [c for c in df.columns if c not in (y, id_col)]
    pts = df.select(F.col(id_col).alias("id"), F.col(y).alias("_y"),
                    F.array(*[F.col(c).cast("double") for c in features]).alias("x"))
    nn1 = knn(pts.select("id", "x"), pts.select("id", "x"), 1, True, block_size)
    nn1 = nn1.where(F.size("nn") > 0).select("id", F.col("nn")[0]["nid"].alias("nid"))
    # mutual nearest neighbours: the unordered pair appears from both ends
    pair = nn1.select(F.least("id", "nid").alias("id_a"), F.greatest("id", "nid").alias("id_b"))
    mutual = pair.groupBy("id_a", "id_b").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == 2)
    ya = pts.select(F.col("id").alias("id_a"), F.col("_y").alias("_ya"))
    yb = pts.select(F.col("id").alias("id_b"), F.col("_y").alias("_yb"))
    links = mutual.join(ya, "id_a").join(yb, "id_b").where(F.col("_ya") != F.col("_yb"))
    return links.select("id_a", "id_b")


def remove_tomek(df: DataFrame, y: str = "y", id_col: str = "row_id", features: list[str] | None = None,
                 block_size: int = BLOCK_SIZE) -> DataFrame:
    """R2: drop **both** ends of every Tomek link (left-anti join)."""
    links = tomek_links(df, y, id_col, features, block_size)
    ends = links.select(F.col("id_a").alias(id_col)).unionByName(links.select(F.col("id_b").alias(id_col)))
    return df.join(ends, id_col, "left_anti")


def smote_tomek(df: DataFrame, y: str = "y", id_col: str = "row_id", features: list[str] | None = None,
                k: int = 5, seed: int = 42) -> DataFrame:
    """SMOTE first, then Tomek-link cleaning on the resampled table."""
    res = smote(df, y, id_col, features, k, seed)
    feats = [c for c in res.columns if c not in (y, id_col, "synthetic")]
    return remove_tomek(res, y, id_col, feats)
