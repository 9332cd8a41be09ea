import numpy as np
from pyspark.sql import functions as F

from riskframe.operators import resample as rs


def _frame(spark, X, y):
    rows = [(i, int(c), *[float(v) for v in x]) for i, (x, c) in enumerate(zip(X, y))]
    return spark.createDataFrame(rows, "row_id long, y int, f0 double, f1 double, f2 double")


def test_knn_matches_bruteforce_across_blocks(spark):
    rng = np.random.default_rng(4)
    X = rng.normal(size=(120, 3))
    pts = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(X)], "id long, x array<double>")
    got = {r.id: [e.nid for e in r.nn] for r in rs.knn(pts, pts, 4, True, block_size=25, query_chunk=30).collect()}
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    np.fill_diagonal(D, np.inf)
    for i in range(len(X)):
        assert got[i] == sorted(range(len(X)), key=lambda j: (D[i, j], j))[:4]


def test_knn_of_one_block_takes_the_shuffle_path(spark):
    pts = spark.createDataFrame([(i, [float(i * i)]) for i in range(30)], "id long, x array<double>")
    out = rs.knn(pts, pts, 2)
    assert "FlatMapCoGroupsInPandas" in out._jdf.queryExecution().toString()
    assert {r.id: [e.nid for e in r.nn] for r in out.collect()}[3] == [2, 4]


def test_smote_balances_and_stays_on_segments(spark):
    rng = np.random.default_rng(8)
    X = np.vstack([rng.normal(0, 1, size=(200, 3)), rng.normal(3, 0.5, size=(23, 3))])
    y = np.array([0] * 200 + [1] * 23)
    out = rs.smote(_frame(spark, X, y), "y", "row_id", ["f0", "f1", "f2"], k=5, seed=1)
    counts = {r.y: r.n for r in out.groupBy("y").agg(F.count("*").alias("n")).collect()}
    assert counts[0] == counts[1] == 200
    mino = X[y == 1]
    syn = np.array([[r.f0, r.f1, r.f2] for r in out.where("synthetic = 1").collect()])
    assert len(syn) == 177
    # every synthetic point is a convex combination of two minority points
    for p in syn:
        best = min(np.linalg.norm(np.cross(p - a, b - a)) / max(np.linalg.norm(b - a), 1e-12)
                   for a in mino for b in mino if not np.allclose(a, b))
        assert best < 1e-9
    again = rs.smote(_frame(spark, X, y), "y", "row_id", ["f0", "f1", "f2"], k=5, seed=1)
    assert sorted(map(tuple, again.where("synthetic = 1").select("f0", "f1", "f2").collect())) == \
        sorted(map(tuple, out.where("synthetic = 1").select("f0", "f1", "f2").collect()))


def test_tomek_links_bruteforce(spark):
    rng = np.random.default_rng(12)
    X = rng.normal(size=(80, 3))
    y = (rng.random(80) < 0.4).astype(int)
    got = {(r.id_a, r.id_b) for r in rs.tomek_links(_frame(spark, X, y), "y", "row_id", ["f0", "f1", "f2"]).collect()}
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    np.fill_diagonal(D, np.inf)
    nn = [min(range(80), key=lambda j: (D[i, j], j)) for i in range(80)]
    exp = {(i, nn[i]) for i in range(80) if nn[nn[i]] == i and i < nn[i] and y[i] != y[nn[i]]}
    assert got == exp
    kept = rs.remove_tomek(_frame(spark, X, y), "y", "row_id", ["f0", "f1", "f2"]).count()
    assert kept == 80 - 2 * len(exp)


def test_knn_prunes_by_pivots_and_stays_exact(spark, monkeypatch):
    """Far groups are not visited; copies of a point count by id, and other
    queries than the candidates are allowed."""
    rng = np.random.default_rng(7)
    X = np.vstack([rng.normal(c, 0.2, size=(60, 4)) for c in (0.0, 5.0, 10.0)] + [np.full((40, 4), 3.0)])
    seen = []
    orig = rs.materialise
    monkeypatch.setattr(rs, "materialise", lambda df, name: (seen.append((name, orig(df, name))), seen[-1][1])[1])
    pts = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(X)], "id long, x array<double>")
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    got = {r.id: [(e.nid, e.dist) for e in r.nn] for r in rs.knn(pts, pts, 3, True, block_size=20, query_chunk=7).collect()}
    np.fill_diagonal(D, np.inf)
    for i in range(len(X)):
        want = sorted(range(len(X)), key=lambda j: (D[i, j], j))[:3]
        assert [n for n, _ in got[i]] == want and np.allclose([d for _, d in got[i]], D[i, want])
    copies = dict(seen)["knn-reached"].count()
    assert 0 < copies < 181 * 9          # 181 different points, about 10 blocks: most are out of reach
    others = spark.createDataFrame([(1, [4.0] * 4), (2, [5.0] * 4), (3, [5.0] * 4)], "id long, x array<double>")
    for r in rs.knn(others, pts, 2, False, block_size=20).collect():
        dist = np.sqrt(((X - (4.0 if r.id == 1 else 5.0)) ** 2).sum(-1))
        assert [e.nid for e in r.nn] == sorted(range(len(X)), key=lambda j: (dist[j], j))[:2]
    assert rs.knn(others, pts.limit(0), 2).first().nn == []


def test_smote_then_tomek_leaves_no_link(spark):
    rng = np.random.default_rng(3)
    X = np.vstack([rng.normal(0, 1, size=(120, 3)), rng.normal(1, 1, size=(30, 3))])
    out = rs.smote_tomek(_frame(spark, X, [0] * 120 + [1] * 30), "y", "row_id", ["f0", "f1", "f2"])
    rows = out.collect()
    n = {c: sum(r.y == c for r in rows) for c in (0, 1)}
    assert n[0] == n[1] < 120           # a link takes one of each class


def test_reached_rows_come_in_bounded_pieces(spark, monkeypatch):
    """F8: what a task copies at a time is bounded, whatever a batch reaches."""
    monkeypatch.setattr(rs, "REACHED", 40)
    pivots = np.array([[0.0], [1.0], [2.0]])
    found = spark.createDataFrame([([i / 50.0], 0, 0, 9.0) for i in range(100)], "x array<double>, cell int, block int, kth double")
    args = found, pivots, {0: 1.0, 1: 1.0, 2: 1.0}, {0: 2, 1: 2, 2: 1}
    reached = rs._reached(*args)
    sizes = reached.mapInArrow(lambda bs: (b.slice(0, 1).select(["cell"]).set_column(
        0, "cell", __import__("pyarrow").array([b.num_rows], "int32")) for b in bs if b.num_rows), "cell int")
    assert reached.count() == 100 * 4 and sizes.count() >= 1
    assert rs._reach_counts(*args) == {0: 100, 1: 200, 2: 100}
    wide = args[0], pivots, {0: 1.0, 1: 1.0, 2: 1.0}, {0: 1, 1: 1, 2: 2}, {0: 0, 1: 0, 2: 1}
    assert rs._reached(*wide).count() == 100 * 3 and rs._reach_counts(*wide) == {0: 100, 1: 100, 2: 100}


def test_wide_blocks_hold_every_cell():
    """small cells share a block, larger ones are cut."""
    assert rs._wide({0: 3, 1: 4, 2: 25, 3: 2, 5: 8}, 10) == ({0: 0, 1: 0, 2: 1, 3: 4, 5: 4}, {0: 1, 1: 1, 2: 3, 3: 1, 5: 1})


def test_knn_over_wide_blocks_matches_bruteforce(spark, monkeypatch):
    """with many blocks reached, a query is copied to a few wide ones."""
    monkeypatch.setattr(rs, "SPREAD", 3)
    taken = []
    wide = rs._wide
    monkeypatch.setattr(rs, "_wide", lambda *a: taken.append(wide(*a)) or taken[-1])
    rng = np.random.default_rng(11)
    X = rng.normal(size=(160, 12))
    X[150:] = X[:10]        # equal points
    pts = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(X)], "id long, x array<double>")
    got = {r.id: [e.nid for e in r.nn] for r in rs.knn(pts, pts, 3, True, block_size=10, query_chunk=20).collect()}
    assert taken and max(taken[0][0].values()) < 15
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    np.fill_diagonal(D, np.inf)
    for i in range(len(X)):
        assert got[i] == sorted(range(len(X)), key=lambda j: (D[i, j], j))[:3]
