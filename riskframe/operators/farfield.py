"""Sums of Euclidean distances in one or two dimensions without all pairs.

Points of a cluster are dealt to blocks by a tree of median cuts.  Blocks
that lie near each other are compared point by point.  For blocks that are
apart (``GAP`` half-widths of either), the distance is a smooth function of
both points: it is interpolated at ``ORDER`` Chebyshev nodes a dimension on
both sides, whose error falls like ``(GAP + sqrt(GAP^2 + 1)) ** -ORDER``, to
about 1e-14 of the distance, which is less than what adding so many doubles
rounds.  Nothing is sampled or left out.  With blocks of about ``n ** (1/3)``
points (times a constant) the work grows like ``n ** (4/3)``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.operators.blocks import _matrix, _median_tree
from riskframe.session import materialise

ORDER = 22                              # nodes a dimension
GAP = 2.0                               # half-widths between blocks that are apart
LEAF_LEAST, LEAVES = 1 << 10, 1 << 12   # points of a block, about; blocks of space at most
BOUNDS = 1 << 24                        # (block, cluster) pairs that are looked at, at most
CELLS = 1 << 17                         # distances at a time

_ANGLES = (2 * np.arange(ORDER) + 1) * np.pi / (2 * ORDER)
_NODES, _TURNS = np.cos(_ANGLES), np.where(np.arange(ORDER) % 2, -1.0, 1.0) * np.sin(_ANGLES)


def _basis(x: np.ndarray, lo: float, hi: float) -> np.ndarray:
    """Each node's Lagrange polynomial at ``x`` (a row a number)."""
    u = (2 * x - lo - hi) / (hi - lo) if hi > lo else np.zeros(len(x))
    diff = u[:, None] - _NODES[None, :]
    row, col = np.nonzero(diff == 0)
    diff[row, col] = 1.0
    out = _TURNS / diff
    out /= out.sum(axis=1, keepdims=True)
    out[row] = 0.0
    out[row, col] = 1.0
    return out


def _nodes(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The ``ORDER ** 2`` nodes of a box, the second dimension fastest."""
    at = [(a + z) / 2 + (z - a) / 2 * _NODES for a, z in zip(lo, hi)]
    return np.stack([np.repeat(at[0], ORDER), np.tile(at[1], ORDER)], axis=1)


def _sums(at: np.ndarray, x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sum of ``w * distance`` to ``x`` from each row of ``at``."""
    out = np.zeros(len(at))
    for lo in range(0, len(x), 4096):
        px, py, pw = np.ascontiguousarray(x[lo:lo + 4096, 0]), np.ascontiguousarray(x[lo:lo + 4096, 1]), w[lo:lo + 4096]
        for a in range(0, len(at), step := max(1, CELLS // len(px))):
            d, e = at[a:a + step, :1] - px, at[a:a + step, 1:] - py
            d *= d
            e *= e
            d += e
            np.sqrt(d, out=d)
            out[a:a + step] += d @ pw
    return out


def _gaps(lo: np.ndarray, hi: np.ndarray, los: np.ndarray, his: np.ndarray) -> np.ndarray:
    return np.sqrt((np.maximum(np.maximum(los - hi, lo - his), 0.0) ** 2).sum(axis=-1))


def _pack(t: pa.Table) -> pa.Table:
    """A block: its points and weights, and what stands for them from afar:
    the nodes' weights, or the points themselves if they are fewer."""
    x, w = _matrix(t["x"]), t["w"].to_numpy().astype(np.float64)
    x = x if x.shape[1] == 2 else np.column_stack([x[:, 0], np.zeros(len(x))])
    lo, hi, mean = x.min(axis=0), x.max(axis=0), (x * w[:, None]).sum(axis=0) / w.sum()
    if len(x) > ORDER ** 2:
        far = (_basis(x[:, 0], lo[0], hi[0]) * w[:, None]).T @ _basis(x[:, 1], lo[1], hi[1])
    else:
        far = np.column_stack([x, w])
    around = [*lo, *hi, *mean, float((((x - mean) ** 2).sum(axis=1) * w).sum())]
    return pa.table({"l": pa.array([t["l"][0].as_py()], pa.int32()), "leaf": pa.array([t["leaf"][0].as_py()], pa.int64()),
                     "size": pa.array([len(x)], pa.int64()), "n": pa.array([int(w.sum())], pa.int64()), "box": pa.array([around], pa.list_(pa.float64())),
                     "far": pa.array([far.tobytes()], pa.binary()), "x": pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()),
                     "w": pa.array([w.tobytes()], pa.binary())})


def _worth_a_look(lo, hi, own, mean, var) -> np.ndarray:
    """``[block, cluster]``: whether a cluster can be nearest on average to a
    point of the block, or is its own.  A mean distance is no less than that
    to the centre, and no more than the root mean square."""
    near = np.sqrt(((np.maximum(np.maximum(lo[:, None] - mean[None], mean[None] - hi[:, None]), 0.0)) ** 2).sum(axis=-1))
    far = np.sqrt((np.maximum(np.abs(lo[:, None] - mean[None]), np.abs(hi[:, None] - mean[None])) ** 2).sum(axis=-1) + var[None])
    far[np.arange(len(own)), own] = np.inf
    out = near <= far.min(axis=1)[:, None] * (1 + 1e-9)
    out[np.arange(len(own)), own] = True
    return out


def silhouette_parts(points: DataFrame) -> DataFrame | None:
    """``(s, n)``, a row a block: the sum of its points' silhouettes and their
    number, from ``points(l, x, w)``, each ``x`` of one or two finite numbers
    and ``w`` equal points.  None if there are too many clusters to look at
    each from every block."""
    spark = points.sparkSession
    points = materialise(points.select("l", "x", "w"), "silhouette-points")
    n = points.count()
    size = max(LEAF_LEAST, round((48_000 * n) ** (1 / 3)), -(-n // LEAVES))
    depth = int(np.ceil(np.log2(max(1.0, n / size))))
    want = 64 << depth
    some = points.sample(min(1.0, want / max(1, n)), seed=7).select("x").limit(2 * want).collect() if depth else []
    width = len(some[0][0]) if some else 1
    dims, cuts = _median_tree(np.array([r[0] for r in some], dtype=np.float64).reshape(len(some), width), depth)

    def leaf_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, at = _matrix(b.column("x")), np.zeros(b.num_rows, dtype=np.int64)
            for _ in range(depth if b.num_rows else 0):
                at = 2 * at + 1 + (x[np.arange(len(x)), dims[at]] > cuts[at])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int64())], names=["l", "x", "w", "leaf"])
    placed = points.mapInArrow(leaf_of, "l int, x array<double>, w bigint, leaf bigint")
    blocks = materialise(placed.groupBy("l", "leaf").applyInArrow(
        _pack, "l int, leaf bigint, size bigint, n bigint, box array<double>, far binary, x binary, w binary"), "silhouette-blocks")
    if blocks.count() * blocks.select("l").distinct().count() > BOUNDS:
        return None
    met = blocks.select("l", "leaf", "size", "n", "box", "far").collect()      # one row a block
    box = np.array([r.box for r in met])
    lo, hi, count, big = box[:, :2], box[:, 2:4], np.array([r.n for r in met]), np.array([r.size for r in met]) > ORDER ** 2
    labels, own = np.unique([r.l for r in met], return_inverse=True)
    total = np.bincount(own, weights=count)
    mean = np.stack([np.bincount(own, weights=count * box[:, 4 + k]) / total for k in (0, 1)], axis=1)
    var = np.bincount(own, weights=box[:, 6] + count * ((box[:, 4:6] - mean[own]) ** 2).sum(axis=1)) / total
    look = _worth_a_look(lo, hi, own, mean, var)
    half = np.where(big, (hi - lo).max(axis=1) / 2, 0.0)
    pairs = [(t, t) for t in range(len(met))]
    for t in range(len(met)):
        close = big & look[t, own] & ~(_gaps(lo[t], hi[t], lo, hi) > GAP * np.maximum(half, half[t]))
        pairs += [(t, int(b)) for b in np.flatnonzero(close) if b != t]
    kept = spark.sparkContext.broadcast((lo, hi, own, big, half, look, total, [r.far for r in met]))

    def silhouettes(table: pa.Table) -> pa.Table:
        lo, hi, own, big, half, look, total, far = kept.value
        t, data = table["t"][0].as_py(), {}
        for b, x, w in zip(table["b"].to_pylist(), table["x"], table["w"]):
            data[b] = np.frombuffer(x.as_buffer()).reshape(-1, 2), np.frombuffer(w.as_buffer())
        x, w = data[t]
        if big[t]:
            nodes, bx, by = _nodes(lo[t], hi[t]), _basis(x[:, 0], lo[t, 0], hi[t, 0]), _basis(x[:, 1], lo[t, 1], hi[t, 1])
        gap = _gaps(lo[t], hi[t], lo, hi)
        mine, best = np.zeros(len(x)), np.full(len(x), np.inf)
        for c in np.flatnonzero(look[t]):
            here, away = [], []         # seen from the points, from their nodes
            for b in np.flatnonzero(own == c):
                if big[b] and b in data:
                    here.append(data[b])
                    continue
                # a block t that is small is always seen from its points
                side = away if big[t] and gap[b] > GAP * max(half[t], half[b]) else here
                if big[b]:
                    side.append((_nodes(lo[b], hi[b]), np.frombuffer(far[b])))
                else:
                    f = np.frombuffer(far[b]).reshape(-1, 3)
                    side.append((f[:, :2], f[:, 2]))
            s = _sums(x, *map(np.concatenate, zip(*here))) if here else np.zeros(len(x))
            if away:
                at_nodes = _sums(nodes, *map(np.concatenate, zip(*away))).reshape(ORDER, ORDER)
                s += ((bx @ at_nodes) * by).sum(axis=1)
            if c == own[t]:
                mine = s / max(total[c] - 1, 1)
            else:
                best = np.minimum(best, s / total[c])
        most = np.maximum(mine, best)
        with np.errstate(invalid="ignore"):
            s = np.where((most > 0) & (total[own[t]] > 1), (best - mine) / np.where(most > 0, most, 1.0), 0.0)
        return pa.table({"s": pa.array([float((s * w).sum())]), "n": pa.array([int(w.sum())], pa.int64())})

    of = spark.createDataFrame(pd.DataFrame({"l": [r.l for r in met], "leaf": [r.leaf for r in met], "b": range(len(met))}), "l int, leaf long, b long")
    numbered = blocks.join(F.broadcast(of), ["l", "leaf"]).select("b", "x", "w")
    todo = F.broadcast(spark.createDataFrame(pd.DataFrame(pairs, columns=["t", "b"], dtype="int64"), "t long, b long"))
    tasks = min(len(met), max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return (numbered.join(todo, "b").select("t", "b", "x", "w").repartition(max(1, tasks), "t").groupBy("t")
            .applyInArrow(silhouettes, "s double, n bigint"))
