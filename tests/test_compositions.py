"""The two compositions, value by value, against pandas / numpy."""

import numpy as np
import pandas as pd
import pytest

from riskframe.plans import fraud
from riskframe.plans.segment import segment
from tests.test_cluster import _np_dbscan

V = ["V1", "V2"]


def _events(n, seed, first):
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < 0.15).astype(int)
    return pd.DataFrame({"row_id": np.arange(first, first + n), "y": y, "Time": rng.integers(0, 200_000, n).astype(float),
                         "Amount": np.exp(rng.normal(3, 1.5, n)), "V1": rng.normal(0, 1, n) + 1.5 * y, "V2": rng.normal(0, 2, n)})


def _features(d):
    la, norm, hour = np.log1p(d.Amount), np.sqrt(d.V1 ** 2 + d.V2 ** 2), (d.Time % 86400) // 3600
    out = d.assign(Log_Amount=la, V_norm=norm, V_norm_pow2=norm ** 2, Hour=hour, Time_sin=np.sin(2 * np.pi * hour / 24))
    for v in V:
        out[f"Amount_x_{v}"], out[f"Norm_x_{v}"] = la * d[v], norm * d[v]
    return out


def _prepared(train, test):
    cols = [c for c in train.columns if c != "row_id"]
    train = train.sort_values("row_id").drop_duplicates(cols).reset_index(drop=True)
    cap = np.quantile(train.Amount, 0.999)
    train, test = (_features(d.assign(Amount=d.Amount.clip(upper=cap))) for d in (train, test))
    scaled = ["Amount", "Log_Amount", "V_norm", "Hour", "Time"]
    q1, med, q3 = (train[scaled].quantile(p) for p in (0.25, 0.5, 0.75))
    for d in (train, test):
        d[scaled] = (d[scaled] - med) / (q3 - q1)
    train["w"] = np.where(train.y == 1, (train.y == 0).sum() / (train.y == 1).sum(), 1.0)
    return train, test


def _auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    d = pos[:, None] - neg[None, :]
    return ((d > 0) + 0.5 * (d == 0)).mean()


@pytest.fixture(scope="module")
def fraud_run(spark):
    train, test = _events(400, 1, 0), _events(200, 2, 10_000)
    again = train.iloc[:25].assign(row_id=np.arange(5_000, 5_025))      # repeated content under other ids
    train = pd.concat([again, train], ignore_index=True)
    seen = {}

    def spy(df, features, fit, k, test=None, model_name="model"):
        if not seen:
            seen.update(train=df.toPandas(), test=test.toPandas(), features=features)
        return real(df, features, fit, k, test=test, model_name=model_name)
    real, fraud.md.oof_scores = fraud.md.oof_scores, spy
    try:
        results, scores = fraud.fraud_scoring(spark.createDataFrame(train), spark.createDataFrame(test), V, "Amount", "Time",
                                              k=3, gbt_params={"maxIter": 3, "maxDepth": 2})
        return train, test, seen, results.toPandas(), scores.toPandas()
    finally:
        fraud.md.oof_scores = real


def test_fraud_frames_hold_the_fitted_values(fraud_run):
    train, test, seen, _, _ = fraud_run
    want_train, want_test = _prepared(train, test)
    for got, want in ((seen["train"], want_train), (seen["test"], want_test)):
        got = got.sort_values("row_id").reset_index(drop=True)
        want = want.sort_values("row_id").reset_index(drop=True)
        assert got.row_id.tolist() == want.row_id.tolist()
        assert set(want.columns) <= set(got.columns)
        for c in want.columns:
            np.testing.assert_allclose(got[c], want[c], rtol=1e-9, atol=1e-9, err_msg=c)
    assert len(seen["train"]) == 400
    assert not {"row_id", "y", "fold", "w"} & set(seen["features"])
    per = seen["train"].groupby(["y", "fold"]).size().unstack()
    assert per.shape == (2, 3) and (per.max(axis=1) - per.min(axis=1) <= 1).all()


def test_fraud_records_match_the_scores(fraud_run):
    _, test, _, results, scores = fraud_run
    wide = scores.pivot(index="row_id", columns="model", values="score")
    assert sorted(wide.columns) == ["boosted", "logistic", "rank_blend"] and len(wide) == len(test)
    blend = sum(wide[m].rank() / len(wide) for m in ("boosted", "logistic")) / 2
    np.testing.assert_allclose(wide.rank_blend, blend, rtol=1e-12)
    y = test.set_index("row_id").y.loc[wide.index].to_numpy()
    for r in results.itertuples():
        s = wide[r.model].to_numpy()
        hit, said = ((s >= 0.5) & (y == 1)).sum(), (s >= 0.5).sum()
        assert r.ROC_AUC == pytest.approx(_auc(y, s), abs=1e-6)
        assert r.Precision == pytest.approx(hit / max(said, 1), abs=1e-6)
        assert r.Recall == pytest.approx(hit / (y == 1).sum(), abs=1e-6)
    assert (results.ROC_AUC > 0.7).all()        # the label moves V1 by 1.5 deviations


IMPUTED, CAPPED, SKEWED = ["a", "b"], ["a", "b", "c"], ["a", "b"]


def _customers():
    rng = np.random.default_rng(5)
    at = np.repeat([[20.0, 5.0, 1.0], [400.0, 60.0, 8.0], [30.0, 300.0, 4.0]], 60, axis=0)
    x = pd.DataFrame(at * np.exp(rng.normal(0, 0.12, at.shape)), columns=["a", "b", "c"])
    x.loc[::40, "a"] = np.nan
    x.loc[7, "c"], x.loc[90, "b"] = 500.0, 90_000.0
    x.insert(0, "id", np.arange(len(x)) * 3)
    return x


def test_segment_values(spark):
    raw = _customers()
    rows = [tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r) for r in raw.astype({"id": object}).itertuples(index=False)]
    rows = [(int(r[0]), *r[1:]) for r in rows]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    eps, least = 0.3, 3
    got = segment(df, "id", impute=IMPUTED, cap=CAPPED, skewed=SKEWED, ratios={"a_to_b": ("a", "b")}, drop=["c"],
                  profile_cols=["a", "b", "c"], n_components=2, eps=eps, min_samples=least)

    x = raw.copy()
    x[IMPUTED] = x[IMPUTED].fillna(x[IMPUTED].median())
    q1, q3 = x[CAPPED].quantile(0.25), x[CAPPED].quantile(0.75)
    low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    report = {r.feature: (r.capped_low, r.capped_high, r.total_capped) for r in got.cap_report.collect()}
    for c in CAPPED:
        below, above = int((x[c] < low[c]).sum()), int((x[c] > high[c]).sum())
        assert report[c] == (below, above, below + above)
    assert report["b"][1] >= 1 and report["c"][1] >= 1
    x[CAPPED] = x[CAPPED].clip(low, high, axis=1)

    f = x[["a", "b"]].apply(np.log1p)
    f["a_to_b"] = f.a / (f.b + 1)
    spread = f.quantile(0.75) - f.quantile(0.25)
    z = ((f - f.median()) / spread.replace(0, 1)).to_numpy()
    _, vec = np.linalg.eigh(np.cov(z.T))
    emb = z @ vec[:, ::-1][:, :2]
    want = _np_dbscan(emb, eps, least)
    labels = {r.id: r.cluster for r in got.labels.collect()}
    found = np.array([labels[i] for i in raw.id])
    np.testing.assert_array_equal(found, want)
    kept = want >= 0
    names = sorted(set(want[kept]))
    assert len(names) >= 2

    d = np.sqrt(((emb[:, None] - emb[None]) ** 2).sum(-1))
    s = []
    for i in np.flatnonzero(kept):
        mean = {c: d[i, want == c].sum() / max((want == c).sum() - (c == want[i]), 1) for c in names}
        own = mean.pop(want[i])
        other = min(mean.values())
        s.append((other - own) / max(own, other) if (want == want[i]).sum() > 1 else 0.0)
    mid = np.array([emb[want == c].mean(axis=0) for c in names])
    wide = np.array([np.sqrt(((emb[want == c] - m) ** 2).sum(-1)).mean() for c, m in zip(names, mid)])
    ratio = [max((wide[i] + wide[j]) / np.linalg.norm(mid[i] - mid[j]) for j in range(len(names)) if j != i) for i in range(len(names))]
    r = got.summary.first()
    assert (r.n_clusters, r.n_noise, r.n_rows) == (len(names), int((~kept).sum()), len(raw))
    assert r.noise_pct == pytest.approx(100 * (~kept).mean())
    assert r.silhouette == pytest.approx(np.mean(s), abs=1e-9)
    assert r.davies_bouldin == pytest.approx(np.mean(ratio), abs=1e-9)

    profile = {r.cluster: (r.a, r.b, r.c) for r in got.profile.collect()}
    sizes = {r.cluster: (r.n, r.share_pct) for r in got.sizes.collect()}
    assert set(profile) == set(sizes) == set(names)
    for c in names:
        mine = x[want == c]
        assert profile[c] == pytest.approx(tuple(mine[["a", "b", "c"]].mean()), abs=0.0051)
        assert sizes[c] == (len(mine), pytest.approx(100 * len(mine) / len(x)))
    export = {r.id: (r.a, r.cluster_label) for r in got.export.collect()}
    assert {i: c for i, (_, c) in export.items()} == labels
    assert [i for i, (a, _) in export.items() if a is None] and len(export) == len(raw)      # source values, not the imputed ones
