"""Whitening against numpy's own eigenvectors and exact integers."""

import numpy as np
import pytest

from riskframe.llm import whitening as wh
from riskframe.llm.queries import QUERIES
from tests.conftest import SF001

SCHEMA = "vec_id long, embedding array<float>, x string"


def _ints(v, scale=64):
    return [int(np.floor(scale * float(c))) + wh.OFFSET for c in v]


def _reference(vectors):
    x = np.array(sorted({tuple(_ints(v)) for _, v in vectors}), dtype=object)
    n, s = len(x), x.sum(axis=0)
    z = np.array(n * x - s, dtype=object)
    cov = np.array((z.T @ z).astype(object) / n ** 3, dtype=float)
    e, u = np.linalg.eigh(cov)
    return n, s, cov, e[::-1], u[:, ::-1]


def _check(rows, vectors, k):
    n, s, cov, e, u = _reference(vectors)
    by = {}
    for r in rows:
        by.setdefault(r.vec_id, []).append(r)
        assert r.n == n and r.identity_error < 1e-9
        assert r.explained == pytest.approx(e[r.component - 1] / np.trace(cov), rel=1e-9)
    sign = {}
    for i, v in vectors:
        z = np.array([n * a - b for a, b in zip(_ints(v), s)], dtype=object)
        for r in by[i]:
            assert r.deviation == sum(int(a) ** 2 for a in z)
            want = float((z.astype(float) / n) @ u[:, r.component - 1]) / np.sqrt(e[r.component - 1])
            f = sign.setdefault(r.component, 1 if want * r.whitened >= 0 else -1)
            assert f * r.whitened == pytest.approx(want, rel=1e-7, abs=1e-9)
        assert {r.component for r in by[i]} == set(range(1, k + 1))


def test_factor_and_rotations():
    rng = np.random.default_rng(0)
    for d, rank in ((1, 1), (2, 2), (7, 7), (12, 5), (64, 64)):
        b = rng.normal(size=(d, rank)) * 10.0 ** rng.uniform(-1.5, 1.5, size=(1, rank))
        a = b @ b.T
        low, order = wh.pivoted_cholesky(a)
        assert np.allclose(low @ low.T, a[order][:, order], rtol=1e-12, atol=1e-12 * a.max())
        assert (np.diff(np.diagonal(low)) <= 1e-9 * low.max()).all() and np.allclose(np.triu(low, 1), 0)
        values, u = wh.principal(a)
        assert len(values) == rank and np.allclose(u.T @ u, np.eye(rank), atol=1e-13)
        assert np.allclose(values[:1], np.linalg.eigvalsh(a)[::-1][:1], rtol=1e-12)
        assert np.allclose((u * values) @ u.T, a, atol=1e-12 * a.max())


def test_gram_is_exact():
    rng = np.random.default_rng(1)
    for most in (3, 1 << 10, (1 << 20) - 1, 1 << 31, 1 << 50):
        y = rng.integers(-most, most + 1, size=(50, 3))
        want = y.astype(object).T @ y.astype(object)
        assert (wh.exact_gram(y) == want).all()


def test_matches_numpy_with_copies_and_odd_rows(spark):
    rng = np.random.default_rng(4)
    base = (rng.normal(size=(300, 6)) * [5, 3, 2, 1, 0.5, 0.2]).astype(np.float32)
    good = [(i, [float(c) for c in base[i % 200]]) for i in range(300)] + [(0, [float(c) for c in base[250]])]
    good = [(i + 1000 * k, v) for k, (i, v) in enumerate(good)]
    bad = [(-1, None), (-2, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (-3, [float("nan")] * 6), (-4, [float("inf")] + [0.0] * 5),
           (-5, []), (-6, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in good + bad], SCHEMA).repartition(4)
    rows = wh.whiten(df, most=4).collect()
    assert len(rows) == 4 * len(good) and all(r.vec_id >= 0 for r in rows)
    _check(rows, good, 4)


def test_few_and_constant_vectors(spark):
    one = spark.createDataFrame([(1, [0.5, 1.0], "")] * 3, SCHEMA)
    assert wh.whiten(one).collect() == [] and wh.whiten(one.limit(0)).collect() == []
    flat = spark.createDataFrame([(i, [float(i), 2.0, -float(i)], "") for i in (0, 1, 3)], SCHEMA)
    rows = wh.whiten(flat).collect()
    assert {r.component for r in rows} == {1} and all(r.explained == pytest.approx(1.0) for r in rows)


def test_query_on_the_table(spark):
    rows = QUERIES["op11_whitening"](spark, SF001).collect()
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF001}/embeddings.parquet").collect()]
    _check(rows, vectors, min(16, len(rows) // len(vectors)))
    assert len(rows) == 16 * len(vectors)
