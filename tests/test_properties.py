"""Property-based checks against brute force on random small inputs."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st_

from riskframe.operators import metrics as mt
from riskframe.operators.quantiles import quantiles
from tests.test_metrics import _ap_bruteforce, _auc_bruteforce

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))

values = st_.lists(st_.one_of(st_.none(), st_.integers(-5, 5).map(float), st_.floats(-1e3, 1e3)),
                   min_size=1, max_size=60)


@SETTINGS
@given(vals=values, p=st_.sampled_from([0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.999, 1.0]))
def test_distributed_quantile_property(spark, vals, p):
    df = spark.createDataFrame([(v,) for v in vals], "a double")
    got = quantiles(df, ["a"], [p]).first().q
    clean = [v for v in vals if v is not None]
    if not clean:
        assert got is None
    else:
        assert got == pytest.approx(float(np.quantile(np.array(clean), p)), rel=1e-9, abs=1e-9)


scored = st_.lists(st_.tuples(st_.integers(0, 1), st_.integers(0, 6).map(lambda x: x / 6.0)), min_size=2, max_size=80)


@SETTINGS
@given(rows=scored)
def test_ranking_metrics_property(spark, rows):
    df = spark.createDataFrame([(i, "m", y, s) for i, (y, s) in enumerate(rows)],
                               "row_id long, model string, y int, score double")
    r = mt.ranking_metrics(df, buckets=3).first()
    ys, ss = [y for y, _ in rows], [s for _, s in rows]
    if 0 < sum(ys) < len(ys):
        assert r.roc_auc == pytest.approx(_auc_bruteforce(ys, ss), abs=1e-12)
        assert r.pr_auc == pytest.approx(_ap_bruteforce(ys, ss), abs=1e-12)
    else:
        assert r.roc_auc is None
