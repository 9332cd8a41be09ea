import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.operators import ensemble as en
from riskframe.operators import metrics as mt
from riskframe.operators import rank as rk


def _scores(spark, rows):
    return spark.createDataFrame(rows, "row_id long, model string, y int, score double")


def _auc_bruteforce(y, s):
    pos = [b for a, b in zip(y, s) if a == 1]
    neg = [b for a, b in zip(y, s) if a == 0]
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def _ap_bruteforce(y, s):
    order = sorted(set(s), reverse=True)
    P = sum(y)
    ap, prev_r = 0.0, 0.0
    for t in order:
        tp = sum(1 for a, b in zip(y, s) if b >= t and a == 1)
        fp = sum(1 for a, b in zip(y, s) if b >= t and a == 0)
        r = tp / P
        ap += (r - prev_r) * (tp / (tp + fp))
        prev_r = r
    return ap


def test_golden_confusion_arithmetic(spark):
    # a logged matrix: TN 83812 FP 1483 FN 25 TP 123
    cm = spark.createDataFrame([(83812, 1483, 25, 123)], "tn long, fp long, fn long, tp long")
    r = mt.with_prf(cm).first()
    assert round(r.precision, 6) == 0.076588
    assert round(r.recall, 6) == 0.831081
    assert round(r.f1, 6) == 0.140251


def test_ranking_metrics_match_bruteforce(spark):
    rng = np.random.default_rng(7)
    rows, ys, ss = [], [], []
    for i in range(400):
        y = int(rng.random() < 0.3)
        s = float(np.round(rng.random() + 0.3 * y, 1))  # many ties
        rows.append((i, "m", y, s))
        ys.append(y)
        ss.append(s)
    r = mt.ranking_metrics(_scores(spark, rows), buckets=4).first()
    assert r.roc_auc == pytest.approx(_auc_bruteforce(ys, ss), abs=1e-12)
    assert r.pr_auc == pytest.approx(_ap_bruteforce(ys, ss), abs=1e-12)


def test_auc_invariants(spark):
    rows = [(i, "a", i % 3 == 0, float(i % 7)) for i in range(90)]
    rows = [(i, m, int(y), s) for i, m, y, s in rows]
    neg = [(i, "b", y, -s) for i, m, y, s in rows]
    mono = [(i, "c", y, s ** 3 + 1) for i, m, y, s in rows]
    tied = [(i, "d", y, 1.0) for i, m, y, s in rows]
    one = [(i, "e", 1, float(i)) for i in range(10)]
    res = {r.model: r for r in mt.ranking_metrics(_scores(spark, rows + neg + mono + tied + one)).collect()}
    assert res["b"].roc_auc == pytest.approx(1 - res["a"].roc_auc)
    assert res["c"].roc_auc == pytest.approx(res["a"].roc_auc)
    assert res["d"].roc_auc == pytest.approx(0.5)
    assert res["e"].roc_auc is None


def test_threshold_sweep_first_max(spark):
    rows = [(i, "m", int(i >= 50), i / 100.0 + 0.001) for i in range(100)]
    grid = mt.step_grid(0.1, 0.9, 0.05)
    assert len(grid) == 16 and grid[14] == 0.8000000000000002
    sweep = mt.threshold_sweep(_scores(spark, rows), grid)
    best = mt.best_threshold(sweep).first()
    assert best.f1 == pytest.approx(1.0)
    assert best.threshold == pytest.approx(0.5)
    lin = mt.linspace_grid(0.01, 0.99, 200)
    assert lin[-1] == 0.99 and len(lin) == 200


def test_average_rank_ties(spark):
    rows = [(1, "m", 0, 0.1), (2, "m", 1, 0.5), (3, "m", 0, 0.5), (4, "m", 1, 0.9)]
    r = {x.row_id: x.rank_pct for x in rk.average_rank(_scores(spark, rows), by=["model"]).collect()}
    assert r == {1: 0.25, 2: 0.625, 3: 0.625, 4: 1.0}


def test_stratified_folds_balance(spark):
    df = spark.range(1003).select(F.col("id").alias("row_id"), (F.col("id") % 7 == 0).cast("int").alias("y"))
    folds = rk.stratified_folds(df, "y", 5, 42)
    counts = {(r.y, r.fold): r.n for r in folds.groupBy("y", "fold").agg(F.count("*").alias("n")).collect()}
    for y in (0, 1):
        sizes = [counts.get((y, f), 0) for f in range(5)]
        assert max(sizes) - min(sizes) <= 1
    assert folds.count() == 1003 and folds.select("row_id").distinct().count() == 1003


def test_weight_search_matches_direct_auc(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(rng.random() < 0.4), float(rng.random()), float(rng.integers(0, 5))) for i in range(300)]
    wide = spark.createDataFrame(rows, "row_id long, y int, a double, b double")
    grid = en.simplex_grid(2, 4)
    res = {r.candidate: r.roc_auc for r in en.weight_search(wide, ["a", "b"], grid).collect()}
    for i, (w1, w2) in enumerate(grid):
        s = [w1 * a + w2 * b for _, _, a, b in rows]
        assert res[i] == pytest.approx(_auc_bruteforce([r[1] for r in rows], s), abs=1e-12)


def test_grouped_metrics_stable_under_filter_pushdown(spark):
    # bucket bounds must be computed once per query even when a filter on
    # the group key is pushed below the prefix sums
    rng = np.random.default_rng(9)
    rows = [(i, m, int(rng.random() < 0.3), float(rng.random())) for m in ("a", "b", "c") for i in range(3000)]
    s = _scores(spark, rows)
    full = {r.model: r.roc_auc for r in mt.ranking_metrics(s).collect()}
    for m in ("a", "b", "c"):
        one = mt.ranking_metrics(s).where(F.col("model") == m).first().roc_auc
        ys = [y for _, mm, y, _ in rows if mm == m]
        ss = [x for _, mm, _, x in rows if mm == m]
        assert one == pytest.approx(full[m], abs=1e-15)
        assert one == pytest.approx(_auc_bruteforce(ys, ss), abs=1e-12)


def test_weight_draw_schemes(spark):
    seq = en.sequential_simplex(50, 3)
    assert all(abs(sum(w) - 1) < 1e-12 and min(w) >= -1e-12 for w in seq)
    line = en.line_grid(5)
    assert line[0] == (0.0, 1.0) and line[-1] == (1.0, 0.0)
    wide = spark.createDataFrame([(i, i % 2, float(i), float(-i)) for i in range(20)],
                                 "row_id long, y int, a double, b double")
    res = {r.candidate: r.roc_auc for r in en.weight_search(wide, ["a", "b"], [(0.0, 0.0), (1.0, 0.0)]).collect()}
    assert res[0] == 0.0 and res[1] == pytest.approx(_auc_bruteforce([i % 2 for i in range(20)], list(range(20))))


def test_qualified_blend_zero_survivors(spark):
    rows = [(i, m, i % 2, float((i * 7) % 5)) for m in ("a", "b") for i in range(10)]
    s = _scores(spark, rows)
    assert en.qualified_rank_blend(s, 0.99).count() == 0
    z = en.qualified_rank_blend(s, 0.99, on_empty="zeros").collect()
    assert len(z) == 10 and all(r.score == 0.0 for r in z)
    assert en.qualified_rank_blend(s, 0.0).count() == 10


def test_missing_scores(spark):
    rows = [(1, "m", 1, 0.9), (2, "m", 0, 0.2), (3, "m", 1, None), (4, "m", 0, float("nan")), (5, "m", 1, 0.6)]
    s = spark.createDataFrame(rows, "row_id long, model string, y int, score double")
    r = mt.ranking_metrics(s).first()
    assert (r.n_pos, r.n_neg) == (2, 1) and r.roc_auc == pytest.approx(1.0)
    sw = {x.t_idx: x for x in mt.threshold_sweep(s, [0.5]).collect()}
    assert (sw[0].tp, sw[0].fp, sw[0].fn) == (2, 0, 1)


def test_confusion_missing_scores_predict_negative(spark):
    rows = [(1, "m", 1, 0.9), (2, "m", 0, float("nan")), (3, "m", 1, None)]
    s = spark.createDataFrame(rows, "row_id long, model string, y int, score double")
    c = mt.confusion(s, 0.5).first()
    assert (c.tn, c.fp, c.fn, c.tp) == (1, 0, 1, 1)


def test_weight_search_over_many_slices(spark, monkeypatch):
    """Exact whatever the slices and batches are, with a hot score and with
    rows that have no score."""
    rng = np.random.default_rng(3)
    a, b, y = rng.random(3000), np.round(rng.random(3000), 1), rng.integers(0, 2, 3000)
    a[:1000] = 0.5
    b[:1000] = 0.5
    rows = [(int(i), int(t), float(u), float(v)) for i, (t, u, v) in enumerate(zip(y, a, b))]
    wide = spark.createDataFrame([*rows, (9000, 1, None, 0.1), (9001, None, 0.9, 0.1)], "row_id long, y int, a double, b double")
    cand = [(0.3, 0.7), (1.0, 0.0), (0.0, 0.0), (0.9, 0.1)]
    for size, cells in ((1 << 18, 1 << 21), (100, 300)):
        monkeypatch.setattr(en, "SLICE_ROWS", size)
        monkeypatch.setattr(en, "CELLS", cells)
        got = {r.candidate: r.roc_auc for r in en.weight_search(wide, ["a", "b"], cand).collect()}
        for i, (u, v) in enumerate(cand):
            s = u * a + v * b
            pos, neg = s[y == 1], s[y == 0]
            want = ((pos[:, None] > neg[None]).sum() + (pos[:, None] == neg[None]).sum() / 2) / (len(pos) * len(neg))
            assert got[i] == pytest.approx(want if u or v else 0.0, abs=1e-12)


def test_weight_search_ships_no_scores(spark, monkeypatch):
    """Only tuples are shuffled, whatever the number of candidates; exact
    with blocks, slices, hot tuples, negative weights and infinite scores."""
    rng = np.random.default_rng(4)
    a, b, y = rng.normal(size=900), np.round(rng.random(900), 1), rng.integers(0, 2, 900)
    a[:400], b[:400], a[400], b[401] = 0.25, 0.5, np.inf, -np.inf
    rows = [(int(i), int(t), float(u), float(v)) for i, (t, u, v) in enumerate(zip(y, a, b))]
    wide = spark.createDataFrame(rows, "row_id long, y int, a double, b double")
    cand = [(0.3, 0.7), (-0.5, 1.5), (0.6, -0.2), (0.0, 0.0)]
    for name, size in (("SLICE_ROWS", 60), ("BLOCK_ROWS", 16), ("CUT_ROWS", 64), ("CELLS", 150), ("SCANS", 7)):
        monkeypatch.setattr(en, name, size)
    out = en.weight_search(wide, ["a", "b"], cand)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "FlatMapGroups" not in plan, plan
    got = {r.candidate: r.roc_auc for r in out.collect()}
    for i, (u, v) in enumerate(cand):
        s = u * a + v * b if u or v else np.zeros(len(a))
        pos, neg = s[y == 1], s[y == 0]
        want = ((pos[:, None] > neg[None]).sum() + (pos[:, None] == neg[None]).sum() / 2) / (len(pos) * len(neg))
        assert got[i] == pytest.approx(want if u or v else 0.0, abs=1e-12)


def test_ranked_counts_ties_zeros_and_nan():
    rng = np.random.default_rng(5)
    for k in range(60):
        v = rng.integers(-3, 4, 40) / 3 * rng.choice([1e-300, 1.0, 1e300], 40)
        v[:k % 3] = np.nan
        p = rng.integers(0, 2 + k % 2, 40)
        q = 1 - p if k % 2 == 0 else rng.integers(0, 3, 40)
        last = np.isnan(v)
        above = (v[:, None] > v[None]) | (last[:, None] & ~last[None])
        equal = (v[:, None] == v[None]) | (last[:, None] & last[None])
        assert en._ranked(v, p, q) == (p.sum(), q.sum(), (p[:, None] * q[None] * (above + equal / 2)).sum())


def test_average_rank_looks_up_frequent_scores(spark, monkeypatch):
    """Frequent and other scores, NULL scores and groups: the same ranks,
    and rows of frequent scores are not in the shuffled join."""
    monkeypatch.setattr(rk, "HOT", 8)
    rows = [(i, m, i % 2, [0.5, 0.5, 0.25, i / 97][i % 4]) for i in range(80) for m in ("a", None)] + [(80, "a", 1, None)]
    got = rk.average_rank(_scores(spark, rows), by=["model"]).collect()
    assert len(got) == len(rows)
    for m in ("a", None):
        s = np.array([r[3] for r in rows if r[1] == m and r[3] is not None])
        for r in (r for r in got if r.model == m):
            want = None if r.score is None else ((s < r.score).sum() + ((s == r.score).sum() + 1) / 2) / len(s)
            assert r.rank_pct == (want if want is None else pytest.approx(want))


def test_rank_blends_are_each_the_rank_blend(spark):
    rows = [(i, m, i % 2, float((i * k) % 7)) for i in range(40) for m, k in (("a", 3), ("b", 5), ("c", 2))]
    blends = {"even": None, "two": {"a": 3.0, "b": 1.0}}
    both = en.rank_blends(_scores(spark, rows + [(99, "c", 1, 3.0)]), blends)
    got = {(r.model, r.row_id): (r.y, r.score) for r in both.collect()}
    want = {(b, r.row_id): (r.y, pytest.approx(r.score))
            for b, w in blends.items() for r in en.rank_blend(_scores(spark, rows + [(99, "c", 1, 3.0)]), w).collect()}
    assert got == want and ("two", 99) not in got
