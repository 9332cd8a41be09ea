import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.operators import quantiles as Q
from riskframe.operators.prefix import prefix_sums, row_positions
from riskframe.operators.quantiles import iqr_fences, quantiles
from riskframe.sources import driver_table

from tests.conftest import SF01


def _np_q(vals, p):
    v = [x for x in vals if x is not None and not (isinstance(x, float) and math.isnan(x))]
    return float(np.quantile(np.array(v, dtype=float), p)) if v else None


def test_quantiles_match_linear_interpolation(spark):
    rows = [(float(x) if x is not None else None, 1.0, None, 5.0) for x in
            [3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5, None, 8, 9, 7, 9, float("nan")]]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    from riskframe.sources.tables import nan_to_null
    df = nan_to_null(df)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = {(r.feature, r.p): r.q for r in quantiles(df, ["a", "b", "c", "d"], probs).collect()}
    for col, idx in (("a", 0), ("b", 1), ("c", 2), ("d", 3)):
        vals = [r[idx] for r in rows]
        for p in probs:
            exp = _np_q(vals, p)
            if exp is None:
                assert got[(col, p)] is None
            else:
                assert got[(col, p)] == pytest.approx(exp, rel=1e-12, abs=1e-12)


def test_distributed_quantiles_on_driver_table(spark, duck):
    li = driver_table(spark, SF01, "lineitem")
    cols = ["l_extendedprice", "l_discount", "l_quantity"]
    got = {(r.feature, r.p): r.q for r in quantiles(li, cols, [0.25, 0.5, 0.999]).collect()}
    for c in cols:
        for p in (0.25, 0.5, 0.999):
            exp = duck.execute(f"SELECT quantile_cont({c}, {p}) FROM lineitem").fetchone()[0]
            assert got[(c, p)] == pytest.approx(exp, rel=1e-12)


def test_iqr_fences_events(spark):
    ev = driver_table(spark, SF01, "events")
    f = iqr_fences(ev, ["value"]).first()
    assert f.q1 == pytest.approx(14.56)
    assert f.q3 == pytest.approx(69.1475)
    assert f.upper == pytest.approx(69.1475 + 1.5 * (69.1475 - 14.56))


def test_prefix_sums_match_cumsum(spark):
    vals = [(g, float(v), 1 + (v % 3)) for g in ("a", "b") for v in range(200)]
    df = spark.createDataFrame(vals, "g string, v double, n int")
    out = prefix_sums(df, "v", ["n"], by=["g"], buckets=5).collect()
    by = {}
    for r in sorted(out, key=lambda r: (r.g, r.v)):
        by.setdefault(r.g, []).append(r)
    for g, rs in by.items():
        run = 0
        for r in rs:
            run += r.n
            assert r.n_cum == run
            assert r.n_tot == sum(x.n for x in rs)
    desc = prefix_sums(df, "v", ["n"], by=["g"], buckets=3, descending=True).where("g = 'a'").collect()
    top = max(desc, key=lambda r: r.v)
    assert top.n_cum == top.n


def test_a_fit_is_a_local_frame(spark):
    """What is built on a fit holds numbers, not the plan of the fit."""
    df = spark.range(10).select(F.col("id").cast("double").alias("a"))
    q = quantiles(df, ["a"], [0.5])
    plan = q._jdf.queryExecution().optimizedPlan().toString()
    assert "LocalRelation" in plan and "Aggregate" not in plan
    assert q.first().q == 4.5
    with pytest.raises(ValueError):
        quantiles(df, ["a"], [0.5], "percentile")


@pytest.mark.parametrize("leave, sketch", [(4_000_000, 2000), (50, 20), (1, 10)])
def test_brackets_narrow_to_the_exact_rank(spark, monkeypatch, leave, sketch):
    """Also with brackets so coarse that they must be cut again and again,
    on ties that cannot be cut and on infinities."""
    monkeypatch.setattr(Q, "LEAVE", leave)
    monkeypatch.setattr(Q, "SKETCH", sketch)
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=3000), rng.integers(0, 3, 3000).astype(float)
    c = np.where(rng.random(3000) < 0.1, -np.inf, np.round(rng.exponential(size=3000), 2))
    df = spark.createDataFrame(list(zip(a.tolist(), b.tolist(), c.tolist())), "a double, b double, c double").repartition(5)
    probs = [0.0, 0.001, 0.3333, 0.5, 0.77, 0.999, 1.0]
    got = {(r.feature, r.p): r.q for r in quantiles(df, ["a", "b", "c"], probs).collect()}
    for name, v in (("a", a), ("b", b), ("c", c)):
        for p in probs:
            h = (len(v) - 1) * p
            lo, hi = np.sort(v)[[math.floor(h), math.ceil(h)]]
            assert got[name, p] == pytest.approx(lo + (hi - lo) * (h - math.floor(h)) if lo != hi else lo, rel=1e-12, nan_ok=True)


def test_a_bracket_that_misses_its_rank_is_opened(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("a"))
    got = Q._counted(df, [Q.Bracket("a", 10, 11, 500.0, 600.0), Q.Bracket("a", 990, 990, 1.0, 3.0)])
    assert [(b.lo, b.hi, b.below, b.inside) for b in got] == [(None, 600.0, 0, 601), (1.0, None, 1, 999)]


def test_row_positions(spark):
    rows = [(i, ["a", "b", None][i % 3 if i % 2 else 0], (i * 7919) % 1000) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, g string, v int").repartition(4)
    for n in (None, 1, 7):
        got = row_positions(df, ["v", "id"], ["g"], buckets=n).collect()
        for g in ("a", "b", None):
            mine = sorted((r for r in got if r.g == g), key=lambda r: (r.v, r.id))
            assert [r.position for r in mine] == list(range(len(mine)))
    assert row_positions(df.limit(0), ["v"], ["g"]).count() == 0


def test_offsets_are_joined_without_moving_the_rows(spark):
    """The slices' offsets are few: no second shuffle of the rows, even if
    the rows are above the broadcast threshold."""
    key, old = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(key, "60000")
    try:
        df = spark.range(40_000).select(F.col("id"), (F.col("id") % 3).alias("g"), F.md5(F.col("id").cast("string")).alias("t"))
        for out in (row_positions(df, ["t", "id"], ["g"], buckets=4), prefix_sums(df, "id", ["id"], ["g"], buckets=4)):
            assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
            assert out.count() == 40_000
    finally:
        spark.conf.set(key, old)
