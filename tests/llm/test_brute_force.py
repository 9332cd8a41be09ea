"""The operators' main numbers against plain loops."""

import collections
import math
import re
import struct

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from riskframe.llm import learning, quality_mil, quality_rules, toxicity, vector_dedup


def test_factorization_machine_scores_by_pairs():
    rng = np.random.default_rng(1)
    size = 1 << toxicity.BITS
    m = {"b": 0.3, "w": rng.normal(size=size).astype(np.float32), "v": rng.normal(0, 0.3, (size, toxicity.FACTORS)).astype(np.float32)}
    texts = [b"one two two three", b"", None, b"four one", "café one".encode()]
    got = toxicity.score(m, texts)
    for t, p in zip(texts, got):
        x = sorted({int(b) for b in toxicity._buckets.of(learning.terms(t))})
        z = m["b"] + sum(float(m["w"][i]) for i in x)
        z += sum(float(m["v"][i].astype(float) @ m["v"][j].astype(float)) for k, i in enumerate(x) for j in x[k + 1:])
        assert p == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-5)


def test_multiple_instance_scores_by_loops():
    rng = np.random.default_rng(2)
    q = quality_mil
    d = q.DIM + q.RATIOS
    m = {"e": rng.normal(size=(1 << q.BITS, q.DIM)), "e2": rng.normal(size=(1 << q.BITS, q.DIM)), "V": rng.normal(size=(d, q.HIDDEN)),
         "U": rng.normal(size=(d, q.HIDDEN)), "w": rng.normal(size=q.HIDDEN), "c": rng.normal(size=d), "b": np.array([0.2])}
    texts = [" ".join(f"W{i % 37}, x{i % 5}" for i in range(150)).encode(), b"", None, b"a b"]
    for (ids, n, ratio), p in zip(q.encode(texts), q.score(m, texts)):
        at, hs = 0, []
        for k, r in zip(n, ratio):
            rows = ids[at:at + k]
            at += k
            mean = sum((m["e"][a] + m["e2"][b] for a, b in rows), np.zeros(q.DIM)) / max(1, k)
            hs.append(np.concatenate([mean, r]))
        a = np.array([float((np.tanh(h @ m["V"]) * (1 / (1 + np.exp(-(h @ m["U"]))))) @ m["w"]) for h in hs])
        alpha = np.exp(a) / np.exp(a).sum()
        z = sum(x * h for x, h in zip(alpha, hs))
        assert p == pytest.approx(1 / (1 + math.exp(-float(z @ m["c"] + m["b"][0]))), rel=1e-6)


def test_log_likelihood_ratio_by_counters(spark):
    q = quality_rules
    rng = np.random.default_rng(3)
    docs = [(i, " ".join(f"w{int(k)}" for k in rng.zipf(1.5, 40) if k < 500)) for i in range(60)] + [(60, None), (61, ""), (None, "w1 w2 w1")]
    trusted = {i for i in range(0, 60, 3)}
    signed = lambda h: h - (1 << 64) if h >> 63 else h

    def grams(t):
        h1 = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        h2 = [signed(xxhash.xxh64_intdigest(struct.pack("<q", b), xxhash.xxh64_intdigest(struct.pack("<q", a), 42))) for a, b in zip(h1, h1[1:])]
        return [(h & (1 << 64) - 1) >> (64 - q.BITS) for h in h1 + h2]
    raw, target = collections.Counter(), collections.Counter()
    for i, t in docs:
        raw.update(grams(t))
        if i in trusted:
            target.update(grams(t))
    share = q.PSEUDO * q.BUCKETS / raw.total()

    def llr(t):
        g = grams(t)
        p = [(target[b] / target.total() + share / q.BUCKETS) / (raw[b] / raw.total() + share / q.BUCKETS) for b in g]
        return sum(round(math.log(x) * q.UNIT) for x in p) / len(g) / q.UNIT if g else 0.0
    df = spark.createDataFrame(docs, "doc_id long, text string")
    ids = spark.createDataFrame([(i,) for i in trusted], "doc_id long")
    for r in q.quality_rules(df, ids).collect():
        assert r.llr == pytest.approx(llr(r.text), abs=2e-6)


def test_an_id_of_many_rows_is_one_training_row(spark, monkeypatch):
    docs = spark.range(100_000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 9).alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(i, f"text {i}") for i in range(20)] + [(30, None)], docs.schema))
    labels = spark.createDataFrame([(i, i % 2) for i in [*range(20), 30]] + [(7, 0), (7, 0)], "doc_id long, toxic int")
    rows = learning.training_rows(docs, labels, "toxic", F.lit(True), 1000).collect()
    assert len(rows) == 21 and {r.y for r in rows if r.t and r.t.startswith(b"t") and len(r.t) == 2} <= {1}
    assert len(learning.training_rows(docs, labels, "toxic", F.lit(True), 10).collect()) == 10
    monkeypatch.setattr(learning, "SAMPLE_BYTES", 50)
    some = learning.training_rows(docs, labels, "toxic", F.lit(True), 1000).collect()
    assert 0 < sum(len(r.t or b"") for r in some) <= 50


def test_vector_links_of_large_saturated_groups(spark):
    """Groups far larger than a list, linked only by their rims; repeated
    ids, null ids and ids that are no integers."""
    rng = np.random.default_rng(8)
    e = np.eye(32)
    c = [e[0], math.cos(0.55) * e[0] + math.sin(0.55) * e[1], e[5], -e[9]]
    x = np.concatenate([k + rng.normal(scale=0.03, size=(120, 32)) for k in c] + [rng.normal(size=(200, 32))])
    mid = math.cos(0.275) * e[0] + math.sin(0.275) * e[1]
    x = np.concatenate([x, [mid], x[:3]])
    names = [f"v{i:04d}" for i in range(len(x) - 3)] + ["v0000", None, "v0002"]
    df = spark.createDataFrame([(n, [float(v) for v in r]) for n, r in zip(names, x)], "vec_id string, embedding array<double>")
    out = vector_dedup.near_duplicates(df).collect()
    z = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = z @ z.T >= 0.9
    np.fill_diagonal(near, False)
    want = collections.Counter((n, int(near[i].sum())) for i, n in enumerate(names))
    assert collections.Counter((r.vec_id, r.n_links) for r in out) == want
    whole = [r for r in out if r.component_id == "v0000"]
    assert len(whole) == 240 + 1 + 3
