import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.operators import cluster as cl


def _np_dbscan(X, eps, min_samples):
    n = len(X)
    D = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1))
    nb = D <= eps
    core = nb.sum(1) >= min_samples
    comp = -np.ones(n, dtype=int)
    for i in range(n):  # components over core points, labelled by min id
        if core[i] and comp[i] < 0:
            stack, members = [i], []
            comp[i] = i
            while stack:
                j = stack.pop()
                members.append(j)
                for k in np.where(nb[j] & core)[0]:
                    if comp[k] < 0:
                        comp[k] = i
                        stack.append(k)
            m = min(members)
            comp[members] = m
    lab = comp.copy()
    for i in range(n):
        if not core[i]:
            c = [comp[k] for k in np.where(nb[i] & core)[0]]
            lab[i] = min(c) if c else -1
    ids = sorted(set(lab[core]))
    ren = {v: r for r, v in enumerate(ids)}
    return np.array([ren[v] if v >= 0 else -1 for v in lab])


def _points(spark, X):
    rows = [(i, [float(v) for v in x]) for i, x in enumerate(X)]
    return spark.createDataFrame(rows, "id long, x array<double>")


@pytest.mark.parametrize("d", [1, 2, 3, 7])
def test_dbscan_matches_bruteforce(spark, d):
    rng = np.random.default_rng(3 + d)
    centers = rng.uniform(-3, 3, size=(4, d))
    X = np.vstack([c + rng.normal(0, 0.25, size=(60, d)) for c in centers] + [rng.uniform(-4, 4, size=(40, d))])
    X = np.vstack([X, X[:5]])  # exact duplicates fall in one cell
    eps, ms = (0.35 if d < 7 else 0.7), 4
    got = {r.id: r.cluster for r in cl.dbscan(_points(spark, X), eps, ms).collect()}
    exp = _np_dbscan(X, eps, ms)
    assert [got[i] for i in range(len(X))] == list(exp)


def test_neighbour_pairs_match_bruteforce(spark):
    rng = np.random.default_rng(11)
    X = rng.uniform(0, 2, size=(250, 2))
    eps = 0.15
    got = {(r.id_a, r.id_b) for r in cl.neighbour_pairs(_points(spark, X), eps).collect()}
    D = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1))
    exp = {(i, j) for i in range(len(X)) for j in range(i + 1, len(X)) if D[i, j] <= eps}
    assert got == exp


def _np_silhouette(X, lab):
    D = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1))
    s = []
    for i in range(len(X)):
        own = lab == lab[i]
        if own.sum() <= 1:
            s.append(0.0)
            continue
        a = D[i, own].sum() / (own.sum() - 1)
        b = min(D[i, lab == c].mean() for c in set(lab) if c != lab[i])
        s.append((b - a) / max(a, b))
    return float(np.mean(s))


def _np_db(X, lab):
    ks = sorted(set(lab))
    C = np.array([X[lab == k].mean(0) for k in ks])
    S = np.array([np.sqrt(((X[lab == k] - C[i]) ** 2).sum(1)).mean() for i, k in enumerate(ks)])
    r = []
    for i in range(len(ks)):
        r.append(max((S[i] + S[j]) / np.sqrt(((C[i] - C[j]) ** 2).sum()) for j in range(len(ks)) if j != i))
    return float(np.mean(r))


def test_quality_indices_match_numpy(spark):
    rng = np.random.default_rng(5)
    X = np.vstack([rng.normal(c, 0.5, size=(40, 3)) for c in (0, 2, 5)] + [[[9, 9, 9]]])
    lab = np.array([0] * 40 + [1] * 40 + [2] * 40 + [3])  # a singleton cluster
    pts = _points(spark, X)
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(lab)], "id long, cluster int")
    sil = cl.silhouette(pts, labels, 2000).first()
    assert sil.silhouette == pytest.approx(_np_silhouette(X, lab), abs=1e-12)
    db = cl.davies_bouldin(pts, labels).first()
    assert db.davies_bouldin == pytest.approx(_np_db(X, lab), abs=1e-12)
    # noise rows are excluded
    noisy = labels.withColumn("cluster", F.when(F.col("id") == 0, -1).otherwise(F.col("cluster")))
    assert cl.silhouette(pts, noisy, 2000).first().n_sample == len(X) - 1


def test_silhouette_counts_all_rows_across_blocks(spark):
    rng = np.random.default_rng(6)
    X = np.vstack([rng.normal(c, 0.5, size=(840, 3)) for c in (0, 2, 5)])
    lab = np.repeat([0, 1, 2], 840)
    pts = _points(spark, X)
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(lab)], "id long, cluster int")
    for out in (cl.silhouette(pts, labels).first(), cl.silhouette(pts, labels, block_size=700).first()):
        assert out.n_sample == len(X)
        assert out.silhouette == pytest.approx(_np_silhouette(X, lab), abs=1e-12)
    assert cl.silhouette(pts, labels, 1260).first().share == 0.5


@pytest.mark.parametrize("d", [1, 2])
def test_silhouette_of_far_blocks_is_that_of_all_pairs(spark, monkeypatch, d):
    """Blocks far apart are not compared point by point; the sums stay those
    of all pairs to rounding, with repeated points, small clusters inside
    large ones and clusters of one point."""
    from riskframe.operators import farfield as ff
    rng = np.random.default_rng(8)
    X = np.vstack([rng.normal(c, s, size=(n, d)) for c, s, n in ((0, 1, 3200), (9, 0.5, 1600), (4, 0.1, 40), (30, 0.0, 7), (-20, 1, 1))])
    X = np.vstack([X, X[:300]])
    lab = np.concatenate([np.repeat([0, 1, 2, 3, 4], [3200, 1600, 40, 7, 1]), np.zeros(300, dtype=int)])
    lab[:20] = 5
    lab[-300:-280] = 5
    pts = _points(spark, X)
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(lab)], "id long, cluster int")
    monkeypatch.setattr(cl, "FAR_ROWS", 100)
    monkeypatch.setattr(ff, "LEAF_LEAST", 550)
    monkeypatch.setattr(cl, "cluster_sums", None)       # all pairs of blocks are not to be formed
    out = cl.silhouette(pts, labels).first()
    assert (out.n_sample, out.n_clusters) == (len(X), 6)
    assert out.silhouette == pytest.approx(_np_silhouette(X, lab), abs=1e-12)


def test_far_sums_are_those_of_all_pairs():
    from riskframe.operators import farfield as ff
    rng = np.random.default_rng(9)
    for shift in ((4.0, 0.0), (0.3, 4.1), (-3.0, 90.0)):
        x, at = rng.uniform(-1, 1, size=(2000, 2)), rng.uniform(-1, 1, size=(500, 2)) + np.array(shift) * 1.001
        lo, hi = x.min(axis=0), x.max(axis=0)
        far = ff._basis(x[:, 0], lo[0], hi[0]).T @ ff._basis(x[:, 1], lo[1], hi[1])
        a, z = at.min(axis=0), at.max(axis=0)
        seen = ff._sums(ff._nodes(a, z), ff._nodes(lo, hi), far.ravel()).reshape(ff.ORDER, ff.ORDER)
        got = ((ff._basis(at[:, 0], a[0], z[0]) @ seen) * ff._basis(at[:, 1], a[1], z[1])).sum(axis=1)
        want = np.sqrt(((at[:, None] - x[None]) ** 2).sum(-1)).sum(axis=1)
        assert np.abs(got / want - 1).max() < 1e-12


def test_pca_embed_shape(spark):
    rng = np.random.default_rng(2)
    X = rng.normal(size=(50, 5)) @ rng.normal(size=(5, 5))
    out = cl.pca_embed(_points(spark, X), 2).collect()
    assert len(out) == 50 and all(len(r.x) == 2 for r in out)


def test_dbscan_hot_cell_matches_bruteforce(spark):
    # a third of all points inside one cell, next to another dense cell and
    # a sparse chain: the two-phase linking must stay exact
    rng = np.random.default_rng(21)
    hot = rng.normal(0, 0.01, size=(600, 2))
    near = rng.normal([0.3, 0.0], 0.02, size=(300, 2))
    far = rng.normal([2.0, 2.0], 0.02, size=(300, 2))
    chain = np.array([[0.5 + 0.12 * i, 0.0] for i in range(10)])
    noise = rng.uniform(-3, 3, size=(600, 2))
    X = np.vstack([hot, near, far, chain, noise])
    eps, ms = 0.15, 4
    got = {r.id: r.cluster for r in cl.dbscan(_points(spark, X), eps, ms).collect()}
    assert [got[i] for i in range(len(X))] == list(_np_dbscan(X, eps, ms))


def test_dbscan_subcell_path_matches_bruteforce(spark):
    # one representative per cell and coarse sub-cells push many dense cell
    # pairs through the certificate / ambiguous-band path
    rng = np.random.default_rng(33)
    X = np.vstack([rng.normal(c, 0.08, size=(250, 2)) for c in ([0, 0], [0.5, 0.1], [3, 3])]
                  + [rng.uniform(-2, 5, size=(150, 2))])
    eps, ms = 0.1, 5
    got = {r.id: r.cluster for r in cl.dbscan(_points(spark, X), eps, ms, parts=2).collect()}
    assert [got[i] for i in range(len(X))] == list(_np_dbscan(X, eps, ms))


def test_dbscan_of_hot_copies_and_of_nothing(spark):
    """Copies of one point are one point with a weight; in 7 dimensions too."""
    rng = np.random.default_rng(2)
    X = np.vstack([np.tile(rng.normal(size=7), (150, 1)), np.tile(rng.normal(size=7), (2, 1)), rng.normal(0, 0.4, size=(150, 7))])
    X[200:203] = X[0] + [[0.1] * 7, [0.25] * 7, [5.0] * 7]
    for eps, ms in ((0.5, 3), (0.9, 4)):
        got = {r.id: r.cluster for r in cl.dbscan(_points(spark, X), eps, ms).collect()}
        assert [got[i] for i in range(len(X))] == list(_np_dbscan(X, eps, ms))
    none = _points(spark, X[:1]).limit(0)
    assert cl.dbscan(none, 0.5, 3).collect() == [] and cl.neighbour_pairs(none, 0.5).collect() == []


def test_neighbour_pairs_in_seven_dimensions(spark):
    rng = np.random.default_rng(5)
    X = np.vstack([rng.normal(0, 0.3, size=(200, 7)), np.zeros((30, 7))])
    got = {(r.id_a, r.id_b): r.dist for r in cl.neighbour_pairs(_points(spark, X), 0.6).collect()}
    D = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1))
    assert set(got) == {(i, j) for i in range(len(X)) for j in range(i + 1, len(X)) if D[i, j] <= 0.6}
    assert all(abs(v - D[k]) < 1e-9 for k, v in got.items())


def test_davies_bouldin_over_blocks_of_centroids(spark, monkeypatch):
    """As many clusters as there are, in any number of blocks."""
    rng = np.random.default_rng(6)
    X, lab = rng.normal(size=(600, 3)), np.repeat(np.arange(150), 4)
    labels = spark.createDataFrame([(i, int(c)) for i, c in enumerate(lab)], "id long, cluster int")
    cent = X.reshape(150, 4, 3).mean(axis=1)
    spread = np.sqrt(((X.reshape(150, 4, 3) - cent[:, None]) ** 2).sum(-1)).mean(axis=1)
    D = np.sqrt(((cent[:, None] - cent[None]) ** 2).sum(-1))
    np.fill_diagonal(D, np.inf)
    want = ((spread[:, None] + spread[None]) / D).max(axis=1).mean()
    for block in (1024, 20):
        monkeypatch.setattr(cl, "CENTROID_BLOCK", block)
        r = cl.davies_bouldin(_points(spark, X), labels).first()
        assert r.davies_bouldin == pytest.approx(want) and r.n_clusters == 150


def test_squared_silhouette_matches_pairs(spark, monkeypatch):
    rng = np.random.default_rng(4)
    X, lab = rng.normal(size=(300, 3)) + 100.0, np.append(np.repeat(np.arange(43), 7)[:298], [90, -1])[:300]
    labels = spark.createDataFrame([(i, int(c)) for i, c in enumerate(lab)], "id long, cluster int")
    keep = lab >= 0
    D = ((X[keep][:, None] - X[keep][None]) ** 2).sum(-1)
    names = lab[keep]
    s = []
    for i in range(len(D)):
        per = {c: D[i][(names == c) & (np.arange(len(D)) != i)] for c in set(names)}
        a, b = per[names[i]], min(v.mean() for c, v in per.items() if c != names[i])
        s.append(0.0 if not len(a) else (b - a.mean()) / max(a.mean(), b))
    for block in (1024, 10):
        monkeypatch.setattr(cl, "CENTROID_BLOCK", block)
        r = cl.silhouette_squared(_points(spark, X), labels).first()
        assert r.silhouette == pytest.approx(np.mean(s), rel=1e-6) and (r.n_sample, r.n_clusters) == (int(keep.sum()), len(set(names)))


@pytest.mark.parametrize("copies", [1, 40])
def test_near_boxes_across_blocks_match_bruteforce(spark, monkeypatch, copies):
    from riskframe.operators import blocks
    monkeypatch.setattr(blocks, "BLOCK_LEAST", 32)      # several blocks, some dealt by chance
    monkeypatch.setattr(blocks, "CELLS", 500)
    rng = np.random.default_rng(8)
    X = np.vstack([rng.normal(0, 0.4, size=(250, 5)), np.tile(rng.normal(0, 0.4, size=(3, 5)), (copies, 1))])
    W = np.where(rng.random(X.shape) < 0.3, 0.1, 0.0)
    rows = [(i, [float(v) for v in x], [float(v) for v in x + w]) for i, (x, w) in enumerate(zip(X, W))]
    boxes = spark.createDataFrame(rows + [(-1, None, None), (-2, [1.0, None, 0.0, 0.0, 0.0], [1.0] * 5)],
                                  "id long, lo array<double>, hi array<double>")
    for hi, top in (("lo", X), ("hi", X + W)):
        found = blocks.near_boxes(boxes, 5, 0.3, "lo", hi, ["id"]).collect()
        got = {(min(r.a_id, r.b_id), max(r.a_id, r.b_id)): r.dist for r in found}
        gap = np.maximum(np.maximum(X[:, None] - top[None], X[None] - top[:, None]), 0.0)
        D = np.sqrt((gap ** 2).sum(-1))
        i, j = np.nonzero(np.triu(D <= 0.3, 1))
        assert len(found) == len(got) and set(got) == set(zip(i.tolist(), j.tolist()))
        assert all(got[a, b] == pytest.approx(D[a, b], abs=1e-12) for a, b in got)


def test_near_boxes_skip_pairs_of_marked_rows(spark):
    rng = np.random.default_rng(9)
    X, mark = rng.normal(0, 0.38, size=(300, 7)), rng.random(300) < 0.5
    pts = _points(spark, X).join(spark.createDataFrame([(i, bool(m)) for i, m in enumerate(mark)], "id long, m boolean"), "id")
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    exp = np.triu((D <= 0.6) & ~(mark[:, None] & mark[None]), 1).sum()
    assert cl.near_boxes(pts, 7, 0.6, "x", "x", ["id", "m"], "m").count() == exp


def test_neighbour_pairs_of_unknown_points_stay_within_their_cell(spark):
    nan = float("nan")
    x = {0: [None] * 5, 1: [None] * 5, 2: [nan] * 5, 3: [0.01] * 5, 4: [0.02] * 5, 5: [9.0] * 5}
    got = {(r.id_a, r.id_b): r.dist for r in cl.neighbour_pairs(
        spark.createDataFrame(list(x.items()), "id long, x array<double>"), 0.5).collect()}
    assert set(got) == {(0, 1), (2, 3), (2, 4), (3, 4)}
    assert got[0, 1] is None and got[2, 3] != got[2, 3] and got[3, 4] == pytest.approx(0.01 * 5 ** 0.5)


def test_range_join_in_two_dimensions_forms_only_its_pairs(spark):
    """No join makes candidates; points of many blocks, of hot cells and
    with odd coordinates pair as those of all pairs do."""
    rng = np.random.default_rng(12)
    X = np.vstack([rng.uniform(0, 30, size=(5000, 2)), np.full((40, 2), 3.0), rng.normal(9, 0.01, size=(60, 2))])
    eps = 0.2
    out = cl.neighbour_pairs(_points(spark, X), eps)
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    D = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1))
    i, j = np.nonzero(np.triu(D <= eps, 1))
    rows = out.collect()
    assert len(rows) == len(i) and {(r.id_a, r.id_b): r.dist for r in rows} == {(a, b): D[a, b] for a, b in zip(i.tolist(), j.tolist())}
    odd = spark.createDataFrame([(1, [float("nan"), 1.0]), (2, [float("nan"), 1.0]), (3, [None, 1.0]), (4, [None, 1.0]), (5, [0.5, 1.0]), (6, [0.55, 1.0])],
                                "id long, x array<double>")
    assert {(r.id_a, r.id_b) for r in cl.neighbour_pairs(odd, eps).collect()} == {(1, 2), (3, 4), (5, 6)}


def test_dbscan_above_three_dimensions_forms_no_pairs(spark, monkeypatch):
    """What tasks return grows with the points, not with near pairs, and a
    chain of points through many blocks is one cluster."""
    from riskframe.operators import blocks
    rng = np.random.default_rng(13)
    dense, t = rng.normal(0, 0.12, size=(700, 7)), np.linspace(0, 60, 900)
    chain = np.column_stack([t, np.sin(t), np.cos(t / 7), *[np.full(900, 5.0)] * 4])
    X = np.vstack([dense, chain, rng.uniform(-30, 30, size=(50, 7)), chain[3:4] + 0.4 * np.eye(7)[6]])
    found, write = {}, cl.materialise
    monkeypatch.setattr(blocks, "BLOCK_LEAST", 100)

    def kept(df, label):
        out = write(df, label)
        found[label] = found.get(label, 0) + out.count()
        return out
    monkeypatch.setattr(cl, "materialise", kept)
    eps, ms = 0.45, 3
    got = {r.id: r.cluster for r in cl.dbscan(_points(spark, X), eps, ms).collect()}
    D = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1))
    near = int((D <= eps).sum() - len(X)) // 2
    assert near > 20 * len(X) and found["dbscan-near"] < near / 3 and found["component-edges"] < near
    assert [got[i] for i in range(len(X))] == list(_np_dbscan(X, eps, ms))
