"""Embedding whitening: pivoted Cholesky, then one-sided Jacobi.

Entries become integers, so counts, sums and the scatter about an integer
centre are exact whatever the order of rows and tasks.  The fit list holds
each distinct integer vector once.  Its centred scatter (dimensions x
dimensions: all that reaches the driver) is factored ``A = L L'`` with
complete pivoting; one-sided Jacobi turns the columns of ``L`` until they are
orthogonal.  Then their squared norms are the eigenvalues of ``A`` and the
normalised columns its eigenvectors.

Defined results.  Vectors that are null or empty, or hold null or non-finite
entries, are dropped, as are those of another length than most (the shorter
length on a tie).  Repeated ids are each whitened; a null id stays.
Components whose eigenvalue is zero up to rounding are left out: a constant
table, a table of one distinct vector and an empty one give an empty result.
Columns of the input other than the id and the vector are ignored.  Entries
times ``scale`` must fit in 52 bits and the deviation in a long, or the job
fails.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.base import materialise

#: Added to every integer entry.
OFFSET = 1_000_000
#: Rows of a step at most.
ROWS = 4096
_EPS = np.finfo(np.float64).eps


# ---- linear algebra on one dimensions x dimensions matrix --------------------

def pivoted_cholesky(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(L, order)`` with ``a[order][:, order] = L L'``: the largest
    remaining diagonal entry is the next pivot, until none is left that
    rounding could not have made."""
    a = a.astype(np.float64).copy()
    n = len(a)
    order, low = np.arange(n), np.zeros((n, n))
    least = n * _EPS * max(a.diagonal().max(initial=0.0), 0.0)
    for k in range(n):
        p = k + int(np.argmax(a.diagonal()[k:]))
        if a[p, p] <= least:
            return low[:, :k], order
        for m in (a, low):
            m[[k, p]] = m[[p, k]]
        a[:, [k, p]] = a[:, [p, k]]
        order[[k, p]] = order[[p, k]]
        low[k, k] = np.sqrt(a[k, k])
        low[k + 1:, k] = a[k + 1:, k] / low[k, k]
        a[k + 1:, k + 1:] -= np.outer(low[k + 1:, k], low[k + 1:, k])
    return low, order


def one_sided_jacobi(low: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """The columns of ``low``, rotated in pairs until all are orthogonal.
    Each round turns disjoint pairs together; a sweep meets all pairs."""
    u = low.copy()
    r = u.shape[1]
    if r < 2:
        return u
    seats = list(range(r)) + [-1] * (r % 2)
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(len(seats) - 1):
            half = len(seats) // 2
            pairs = [(min(p, q), max(p, q)) for p, q in zip(seats[:half], reversed(seats[half:])) if p >= 0 and q >= 0]
            p, q = np.array(pairs).T
            x, y = u[:, p], u[:, q]
            a, b, c = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            size = np.sqrt(a * b)
            off = np.divide(np.abs(c), size, out=np.zeros_like(c), where=size > 0)
            worst = max(worst, off.max())
            turn = off > _EPS
            zeta = np.divide(b - a, 2 * c, out=np.zeros_like(c), where=turn)
            t = np.where(turn, np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta)), 0.0)
            cos = 1 / np.hypot(1.0, t)
            sin = cos * t
            u[:, p], u[:, q] = cos * x - sin * y, sin * x + cos * y
            seats = [seats[0], seats[-1], *seats[1:-1]]
        if worst <= 4 * _EPS * np.sqrt(len(u)):
            return u
    raise ArithmeticError("one-sided Jacobi did not converge")


def principal(scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(eigenvalues, components as columns)`` of a centred scatter, by
    falling eigenvalue; those that are zero up to rounding are left out."""
    low, order = pivoted_cholesky(scatter)
    u = one_sided_jacobi(low)
    norm = np.sqrt((u * u).sum(0))
    by = np.argsort(-norm, kind="stable")
    u, norm = u[:, by], norm[by]
    keep = norm ** 2 > len(scatter) * _EPS * (norm ** 2).max(initial=0.0)
    out = np.empty((len(scatter), int(keep.sum())))
    out[order] = u[:, keep] / norm[keep]
    return norm[keep] ** 2, out


# ---- Spark --------------------------------------------------------------------

@dataclass(frozen=True)
class Whitening:
    """What a fit is: counts and sums (exact), components and eigenvalues."""
    n: int
    sums: list[int]
    values: np.ndarray      # of the covariance, all that are not zero
    components: np.ndarray  # a column each
    trace: float

    def whiten(self, x: np.ndarray, k: int) -> np.ndarray:
        # n x - S is exact; one rounding when it is divided
        return (self.deviations(x) / self.n) @ self.components[:, :k] / np.sqrt(self.values[:k])

    def deviations(self, x: np.ndarray) -> np.ndarray:
        return x * np.int64(self.n) - np.array(self.sums, dtype=np.int64)


def integers(vector: Column, scale: int = 64) -> Column:
    """``floor(scale * c) + OFFSET`` of every entry, as longs."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(scale))) + F.lit(OFFSET))


def prepared(vectors: DataFrame, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, x array<long>)`` of the vectors that take part."""
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    ok = (vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v"))
          .where(F.col("v").isNotNull() & (F.size("v") > 0) & finite))
    lengths = ok.groupBy(F.size("v").alias("k")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "k").first()
    return ok.where(F.size("v") == (lengths.k if lengths else 0)).select("vec_id", integers(F.col("v"), scale).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _blocks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            part = b.slice(at, ROWS)
            yield part, _matrix(part.column(column))


def exact_gram(y: np.ndarray) -> np.ndarray:
    """``y' y`` of integers, exact (as Python integers): products and their
    sums stay below 2^53 in a step of rows, larger entries go in two parts."""
    most = int(np.abs(y).max(initial=0))
    if most < 1 << 20:
        step = max(1, (1 << 52) // max(1, most * most))
        out = np.zeros((y.shape[1],) * 2, dtype=object)
        for at in range(0, len(y), step):
            part = y[at:at + step].astype(np.float64)
            out = out + (part.T @ part).astype(np.int64).astype(object)
        return out
    high = y >> 20
    low = y - (high << 20)
    if int(np.abs(high).max(initial=0)) >= 1 << 32:
        raise OverflowError("entries do not fit in 52 bits")
    both = np.concatenate([high >> 16, high - ((high >> 16) << 16), low], axis=1)
    g, d = exact_gram(both), y.shape[1]
    w = [1 << 36, 1 << 20, 1]
    return sum(w[i] * w[j] * g[i * d:(i + 1) * d, j * d:(j + 1) * d] for i in range(3) for j in range(3))


def _summed(fit: DataFrame, dim: int, what) -> dict[tuple[int, int], int]:
    """Sums over all rows of the matrices that ``what`` makes of blocks of
    rows, added in a shuffle; ``(i, j) -> sum`` reaches the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in _blocks(batches, 0):
            m = what(x)
            total = m if total is None else total + m
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()),
                                              pa.array([str(v) for v in total.ravel().tolist()], pa.string())], names=["i", "j", "s"])
    parts = fit.select("x").mapInArrow(run, "i int, j int, s string")
    return {(r.i, r.j): r.s for r in parts.groupBy("i", "j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()}


def fit_whitening(fit: DataFrame) -> Whitening | None:
    """From ``(x array<long>)``, one row a distinct vector; None if empty."""
    first = fit.select(F.size("x").alias("k")).first()
    if first is None:
        return None
    dim, n = first.k, fit.count()
    got = _summed(fit, dim, lambda x: x.sum(axis=0, dtype=np.int64)[None, :].astype(object))
    sums = [int(got[0, i]) for i in range(dim)]
    centre = np.array([(2 * s + n) // (2 * n) for s in sums], dtype=np.int64)       # the rounded means
    got = _summed(fit, dim, lambda x: exact_gram(x - centre))
    rest = [s - n * int(c) for s, c in zip(sums, centre)]
    # n * scatter about the true mean, exact; one rounding when it is divided
    scatter = np.array([[(n * int(got[i, j]) - rest[i] * rest[j]) / (n * n) for j in range(dim)] for i in range(dim)])
    values, components = principal(scatter)
    return Whitening(n, sums, values, components, float(scatter.trace()))


def identity_error(fit: DataFrame, model: Whitening, k: int) -> float:
    """The largest entry of the whitened fit list's covariance minus the
    identity."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, line = np.zeros((k, k)), np.zeros(k)
        for _, x in _blocks(batches, 0):
            w = model.whiten(x, k)
            total, line = total + w.T @ w, line + w.sum(axis=0)
        i, j = np.indices((k + 1, k))
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()),
                                          pa.array(np.concatenate([total, line[None]]).ravel())], names=["i", "j", "s"])
    got = {(r.i, r.j): r.s for r in fit.select("x").mapInArrow(run, "i int, j int, s double").groupBy("i", "j")
           .agg(F.sum("s").alias("s")).collect()}
    mean = np.array([got[k, j] for j in range(k)]) / model.n
    cov = np.array([[got[i, j] for j in range(k)] for i in range(k)]) / model.n - np.outer(mean, mean)
    return float(np.abs(cov - np.eye(k)).max())


def whiten(vectors: DataFrame, most: int = 16, scale: int = 64, id_col: str = "vec_id",
           vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained,
    identity_error)``, a row for each vector and component (1 to ``most``)."""
    rows = materialise(prepared(vectors, scale, id_col, vector_col), "whitening-rows")
    fit = materialise(rows.select("x").distinct(), "whitening-fit")
    kind = rows.schema["vec_id"].dataType.simpleString()
    shape = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit_whitening(fit)
    k = 0 if model is None else min(most, len(model.values))
    if k == 0:
        return rows.sparkSession.createDataFrame([], shape)
    error = identity_error(fit, model, k)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part, x in _blocks(batches, 1):
            z = m.deviations(x)
            if int(np.abs(z).max()) >= 1 << 30:         # squares might not fit: exact integers
                dev = pa.array([sum(v * v for v in row) for row in z.tolist()], pa.int64())
            else:
                dev = pa.array((z * z).sum(axis=1))
            take = pa.array(np.repeat(np.arange(len(x)), k))
            full = len(x) * k
            yield pa.RecordBatch.from_arrays([
                part.column(0).take(take), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(full, m.n)), dev.take(take), pa.array(m.whiten(x, k).ravel()),
                pa.array(np.tile(m.values[:k] / m.trace, len(x))), pa.array(np.full(full, error))],
                names=[f.split(" ")[0] for f in shape.split(", ")])
    return rows.mapInArrow(run, shape)
