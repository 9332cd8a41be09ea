"""Vectorised distance kernels for pairs of bounded blocks.

Chunks of query points meet blocks of candidates by shuffle, and each pair
is one group that numpy scores in a task, so per-pair arithmetic never
becomes rows or interpreted lambdas.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.session import materialise


def _chunks(n: int, step: int):
    for i in range(0, n, step):
        yield slice(i, min(i + step, n))


def distances(Q: np.ndarray, X: np.ndarray, step: int = 256):
    """Yield (slice, distances[q, m]) by products; near pairs, whose product
    form would cancel, by direct differences."""
    xx = np.einsum("md,md->m", X, X)
    for sl in _chunks(len(Q), step):
        q = Q[sl]
        both = np.einsum("qd,qd->q", q, q)[:, None] + xx[None, :]
        d2 = both - 2 * (q @ X.T)
        i, j = np.nonzero(d2 < 0.02 * both)
        for at in _chunks(len(i), 1 << 16):
            diff = q[i[at]] - X[j[at]]
            d2[i[at], j[at]] = np.einsum("nd,nd->n", diff, diff)
        yield sl, np.sqrt(d2)


def cluster_sums(points: DataFrame, n_chunks: int) -> DataFrame:
    """``(id, l, cl, n, s)``: for every point of ``points(id, l, x)`` and
    every cluster, the number of points and the sum of distances to them.

    Every (chunk, block) pair of point sets, dealt by hash, is one group of
    ``cogroup(...).applyInPandas``; nothing passes through the driver."""
    itype = id_type_of(points)
    others = F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1)))
    own = F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(n_chunks)).cast("int")
    q = points.select("id", "l", "x", own.alias("_qc"), others.alias("_blk"))
    c = points.select(F.col("l").alias("cl"), F.col("x").alias("cx"), own.alias("_blk"), others.alias("_qc"))

    def fn(qpdf: pd.DataFrame, cpdf: pd.DataFrame) -> pd.DataFrame:
        if len(qpdf) == 0 or len(cpdf) == 0:
            return pd.DataFrame({"id": [], "l": [], "cl": [], "n": [], "s": []})
        Q = np.array(qpdf["x"].tolist(), dtype=np.float64)
        X = np.array(cpdf["cx"].tolist(), dtype=np.float64)
        uniq, at, n = np.unique(cpdf["cl"].to_numpy(), return_inverse=True, return_counts=True)
        order = np.argsort(at, kind="stable")
        starts = np.concatenate([[0], np.cumsum(n)[:-1]])
        s = np.concatenate([np.add.reduceat(D, starts, axis=1) for _, D in distances(Q, X[order])])
        k = len(uniq)
        return pd.DataFrame({"id": np.repeat(qpdf["id"].to_numpy(dtype=object), k), "l": np.repeat(qpdf["l"].to_numpy(), k),
                             "cl": np.tile(uniq, len(Q)), "n": np.tile(n, len(Q)), "s": s.ravel()})
    parts = q.groupBy("_qc", "_blk").cogroup(c.groupBy("_qc", "_blk")).applyInPandas(
        fn, f"id {itype}, l int, cl int, n bigint, s double")
    return parts.groupBy("id", "l", "cl").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


def worst_ratios(clusters: DataFrame, n_chunks: int) -> DataFrame:
    """``(id, r)``: for every cluster of ``clusters(id, x, s)`` the largest
    ``(s + s') / distance`` to another one (0 if their centres coincide);
    no row for a single cluster.  Blocks meet as in ``cluster_sums``."""
    others = F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1)))
    own = F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(n_chunks)).cast("int")
    q = clusters.select("id", "x", "s", own.alias("_qc"), others.alias("_blk"))
    c = clusters.select(F.col("id").alias("cid"), F.col("x").alias("cx"), F.col("s").alias("cs"),
                        own.alias("_blk"), others.alias("_qc"))

    def fn(qpdf: pd.DataFrame, cpdf: pd.DataFrame) -> pd.DataFrame:
        if len(qpdf) == 0 or len(cpdf) == 0:
            return pd.DataFrame({"id": [], "r": []})
        Q, X = (np.array(v.tolist(), dtype=np.float64) for v in (qpdf["x"], cpdf["cx"]))
        ids, out = cpdf["cid"].to_numpy(), []
        for sl, D in distances(Q, X):
            r = np.divide(qpdf["s"].to_numpy()[sl, None] + cpdf["cs"].to_numpy()[None, :], D, out=np.zeros_like(D), where=D > 0)
            r[qpdf["id"].to_numpy()[sl, None] == ids[None, :]] = -1.0
            out.append(r.max(axis=1))
        return pd.DataFrame({"id": qpdf["id"], "r": np.concatenate(out)})
    parts = q.groupBy("_qc", "_blk").cogroup(c.groupBy("_qc", "_blk")).applyInPandas(fn, f"id {id_type_of(clusters)}, r double")
    return parts.where("r >= 0").groupBy("id").agg(F.max("r").alias("r"))


def id_type_of(df: DataFrame) -> str:
    return df.schema["id"].dataType.simpleString()


def nearest(Q: np.ndarray, X: np.ndarray, k: int, within: np.ndarray):
    """``(query, candidate, distance)`` of the ``k`` nearest rows of ``X`` to
    each row of ``Q``, at most ``within[query]`` away, by (distance, row).
    Products find them up to rounding, direct differences decide."""
    xx = np.einsum("md,md->m", X, X)
    k = min(k, len(X))
    out = []
    for sl in _chunks(len(Q), max(1, (1 << 22) // max(1, len(X)))):
        q = Q[sl]
        both = np.einsum("qd,qd->q", q, q)[:, None] + xx[None, :]
        d2 = both - 2 * (q @ X.T)
        slack = 1e-9 * both
        most = np.minimum(np.partition(d2 + slack, k - 1, axis=1)[:, k - 1], within[sl] ** 2 * (1 + 1e-9))
        i, j = np.nonzero(d2 - slack <= most[:, None])
        dist = np.empty(len(i))
        for at in _chunks(len(i), 1 << 16):
            diff = q[i[at]] - X[j[at]]
            dist[at] = np.sqrt(np.einsum("nd,nd->n", diff, diff))
        order = np.lexsort((j, dist, i))
        i, j, dist = i[order], j[order], dist[order]
        first = np.searchsorted(i, np.arange(len(q)))
        keep = (np.arange(len(i)) - first[i] < k) & (dist <= within[sl][i])
        out.append((i[keep] + sl.start, j[keep], dist[keep]))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def pivot_distances(X: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.concatenate([np.sqrt(((X[sl, None, :] - pivots[None]) ** 2).sum(-1))
                           for sl in _chunks(len(X), max(1, (1 << 20) // max(1, pivots.size)))] or [np.zeros((0, len(pivots)))])


def topk_cogroup(query: DataFrame, candidates: DataFrame, keys: list[str], k: int, id_type: str) -> DataFrame:
    """Per group of ``keys`` the ``k`` nearest of ``candidates(keys, cx,
    ids)`` within ``within`` of each row of ``query(keys, x, within)``:
    ``(x, kth, nn array<struct<dist, ids>>)``, ``kth`` the distance of the
    k-th (infinite if there are fewer).  Groups are bounded blocks; their
    candidates go in the order of their first id, so that decides ties."""
    def fn(qpdf: pd.DataFrame, cpdf: pd.DataFrame) -> pd.DataFrame:
        if len(qpdf) == 0:
            none = pd.Series([], dtype=object)
            return pd.DataFrame({"x": none, "kth": pd.Series([], dtype=float), "nn": none})
        kth, nn = np.full(len(qpdf), np.inf), [[] for _ in range(len(qpdf))]
        if len(cpdf):
            ids = cpdf["ids"].to_numpy()
            order = sorted(range(len(ids)), key=lambda i: ids[i][0])
            Q, X = (np.array(v.tolist(), dtype=np.float64) for v in (qpdf["x"], cpdf["cx"].iloc[order]))
            i, j, dist = nearest(Q, X, k, qpdf["within"].to_numpy(dtype=np.float64))
            n = np.bincount(i, minlength=len(Q))
            at = np.cumsum(n) - n
            full = n == k
            kth[full] = dist[at[full] + k - 1]
            rows = [{"dist": float(d), "ids": list(ids[order[c]])} for c, d in zip(j, dist)]
            nn = [rows[a:a + m] for a, m in zip(at, n)]
        return pd.DataFrame({"x": qpdf["x"], "kth": kth, "nn": nn})
    return query.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInPandas(
        fn, f"x array<double>, kth double, nn array<struct<dist: double, ids: array<{id_type}>>>")


# ---- boxes that come near --------------------------------------------------------

BLOCKS = 64                             # blocks aimed at
BLOCK_LEAST, BLOCK_MOST = 1 << 11, 1 << 16      # rows of a block, about
TREE_SAMPLE = 20_000                    # rows that bound the blocks
CELLS = 1 << 20                         # pairs that are compared at a time


def _median_tree(X: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """``(dimension, cut)`` of each node of a tree of median cuts, the widest
    dimension first; node ``k`` has the children ``2k + 1`` and ``2k + 2``."""
    dims, cuts = np.zeros((1 << depth) - 1, dtype=np.int64), np.zeros((1 << depth) - 1)
    at = np.zeros(len(X), dtype=np.int64)
    for k in range(len(dims)):
        mine = np.flatnonzero(at == k)
        if len(mine):
            dims[k] = np.ptp(X[mine], axis=0).argmax()
            cuts[k] = np.median(X[mine, dims[k]])
            at[mine] = 2 * k + 1 + (X[mine, dims[k]] > cuts[k])
    return dims, cuts


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _gaps2(alo, ahi, blo, bhi) -> np.ndarray:
    """Squared gaps of boxes; corners' last axis is the dimension."""
    out = 0.0
    for k in range(alo.shape[-1]):
        step = np.maximum(np.maximum(alo[..., k] - bhi[..., k], blo[..., k] - ahi[..., k]), 0.0)
        out = out + step * step
    return out


class Found:
    """What a task makes of the near pairs ``(i, j)`` of rows of its tables
    ``one`` and ``two`` (``two is one`` within a block): here a row a pair."""

    def __init__(self, keep: list[str], one: pa.Table, two: pa.Table):
        self.keep, self.one, self.two = keep, one, two

    def wanted(self, i: np.ndarray, j: np.ndarray) -> np.ndarray | None:
        """Which pairs to look at; None: all."""
        return None

    def add(self, i: np.ndarray, j: np.ndarray, dist: np.ndarray) -> Iterator[pa.RecordBatch]:
        i, j = pa.array(i), pa.array(j)
        yield pa.RecordBatch.from_arrays([*(_taken(self.one[c], i) for c in self.keep), *(_taken(self.two[c], j) for c in self.keep), pa.array(dist)],
                                         names=[*(f"{s}_{c}" for s in "ab" for c in self.keep), "dist"])

    def end(self) -> Iterator[pa.RecordBatch]:
        yield from ()


def near_boxes(rows: DataFrame, d: int, eps: float, lo: str, hi: str, keep: list[str], skip: str | None = None,
               made: tuple[type[Found], str] | None = None) -> DataFrame:
    """``(a_..., b_..., dist)``: the columns ``keep`` of each unordered pair of
    rows whose boxes (``lo`` to ``hi``, arrays of ``d`` numbers; a point has
    ``lo = hi``) are at most ``eps`` apart, once, in any order, and their
    distance.  Of two rows with ``skip`` (one of ``keep``) no pair is made.
    ``made``, a kind of ``Found`` and its columns, makes something less of
    the pairs where they are found.

    Rows are dealt to blocks by a tree of median cuts that a bounded sample
    gives; a block of too many rows (equal ones cannot be cut) is dealt by
    chance.  Each pair of blocks whose rows' bounds come near is a group, of
    those rows of either that come near the other's bounds.
    Products of centres find what may be near, corners decide, so only true
    pairs become rows.  A row travels once a partner block that it is near:
    about ``BLOCKS`` times at most, up to ``BLOCKS * BLOCK_MOST`` rows."""
    spark = rows.sparkSession
    whole = rows.where(F.forall(lo, lambda v: v.isNotNull() & ~F.isnan(v)) & F.forall(hi, lambda v: v.isNotNull() & ~F.isnan(v)))
    cols = list(dict.fromkeys([*keep, lo, hi]))
    whole = materialise(whole.select(*cols), "near-boxes")
    n = whole.count()
    size = min(max(n // BLOCKS, BLOCK_LEAST), BLOCK_MOST)
    depth = int(np.ceil(np.log2(max(1.0, n / size))))
    some = whole.sample(min(1.0, TREE_SAMPLE / max(1, n)), seed=7).select(lo).limit(2 * TREE_SAMPLE).collect() if depth else []
    dims, cuts = _median_tree(np.array([r[0] for r in some], dtype=np.float64).reshape(len(some), d), depth)

    def leaf_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(lo))
            at = np.zeros(b.num_rows, dtype=np.int64)
            for _ in range(depth if b.num_rows else 0):
                at = 2 * at + 1 + (x[np.arange(len(x)), dims[at]] > cuts[at])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int64())], names=[*cols, "_leaf"])
    kinds = {f.name: f.dataType.simpleString() for f in whole.schema.fields}
    kept = ", ".join(f"{c} {kinds[c]}" for c in cols)
    placed = materialise(whole.mapInArrow(leaf_of, f"{kept}, _leaf long").withColumn("_r", F.rand(7)), "near-boxes")
    bounds = [F.min(F.col(lo)[k]) for k in range(d)] + [F.max(F.col(hi)[k]) for k in range(d)]
    leaves = placed.groupBy("_leaf").agg(F.count(F.lit(1)), F.array(*bounds)).collect()     # one row a block
    parts = [max(1, -(-r[1] // (2 * size))) for r in leaves]
    first, many = np.cumsum([0, *parts]), np.array(parts, dtype=np.int64)
    corner = np.array([r[2] for r in leaves], dtype=np.float64).reshape(len(leaves), 2, d)
    leaf_ids = np.array([r[0] for r in leaves], dtype=np.int64)
    order = np.argsort(leaf_ids)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a row goes only to blocks whose bounds it comes near
        for b in batches:
            los, his = _matrix(b.column(lo)), _matrix(b.column(hi))
            leaf = order[np.searchsorted(leaf_ids, b.column("_leaf").to_numpy(), sorter=order)]
            block = first[leaf] + np.floor(b.column("_r").to_numpy() * many[leaf]).astype(np.int64)
            for sl in _chunks(b.num_rows, max(1, (CELLS >> 3) // max(1, len(leaves)))):
                with np.errstate(invalid="ignore"):
                    apart = _gaps2(los[sl, None], his[sl, None], corner[None, :, 0], corner[None, :, 1])
                i, x = np.nonzero(~(apart > eps * eps * (1 + 1e-9)))
                n = many[x]
                at = np.repeat(first[x] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                i = np.repeat(i + sl.start, n)
                own = block[i]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.minimum(own, at)), pa.array(np.maximum(own, at)), pa.array(own > at), *(b.column(c).take(pa.array(i)) for c in cols)],
                    names=["_a", "_b", "_side", *cols])
    kind, out = made or (Found, ", ".join(f"{s}_{c} {kinds[c]}" for s in "ab" for c in keep) + ", dist double")
    point = lo == hi

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        side = t["_side"].to_numpy()
        one, own = t.filter(pa.array(~side)), t["_a"][0].as_py() == t["_b"][0].as_py()
        two = one if own else t.filter(pa.array(side))
        if not one.num_rows or not two.num_rows:
            return
        one = one.combine_chunks()
        two = one if own else two.combine_chunks()
        alo, ahi, blo, bhi = _matrix(one[lo]), _matrix(one[hi]), _matrix(two[lo]), _matrix(two[hi])
        one_skips, two_skips = (t[skip].to_numpy() if skip else None for t in (one, two))
        origin = alo.mean(axis=0)       # products lose least about the middle
        a, b = (alo + ahi) / 2 - origin, (blo + bhi) / 2 - origin
        ar, br = (np.sqrt(((hi_ - lo_) ** 2).sum(axis=1)) / 2 for lo_, hi_ in ((alo, ahi), (blo, bhi)))
        aa, bb = np.einsum("nd,nd->n", a, a), np.einsum("nd,nd->n", b, b)
        found = kind(keep, one, two)
        for sl in _chunks(len(a), max(1, CELLS // len(b))):
            # not above the limit: what is not a number goes on to the corners
            reach = (eps if point else eps + ar[sl, None] + br[None, :]) ** 2
            d2 = a[sl] @ (-2.0 * b.T)
            d2 += (aa[sl] * (1 - 1e-9))[:, None]
            d2 += (bb * (1 - 1e-9))[None, :]
            i, j = np.nonzero(~(d2 > reach * (1 + 1e-9)))
            i += sl.start
            if own:
                i, j = i[i < j], j[i < j]
            if skip:
                ok = ~(one_skips[i] & two_skips[j])
                i, j = i[ok], j[ok]
            ok = found.wanted(i, j)
            if ok is not None:
                i, j = i[ok], j[ok]
            dist = np.sqrt(_gaps2(alo[i], ahi[i], blo[j], bhi[j]))
            ok = dist <= eps * (1 if point else 1 + 1e-9)
            yield from found.add(i[ok], j[ok], dist[ok])
        yield from found.end()
    # few bytes, much work: AQE is not to put the groups into a task or two
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = placed.mapInArrow(deal, f"_a long, _b long, _side boolean, {kept}").repartition(tasks, "_a", "_b")
    return dealt.groupBy("_a", "_b").applyInArrow(compare, out)


def _taken(column: pa.ChunkedArray, at: pa.Array) -> pa.Array:
    return column.combine_chunks().take(at)
