"""Toxicity: a factorization machine over hashed terms.

logit = b + sum_i w_i + sum_{i<j} <v_i, v_j> over the distinct terms of the
whole text, so a pair of terms can weigh more than both apart.  Fitted with
AdaGrad on a bounded sample of labelled rows (``SAMPLE``); terms that fewer
than ``MIN_DF`` sample documents hold, or that are as common in both classes
as chance allows (``MIN_Z``), alone and in every pair of such terms
(``PAIR_Z``, from ``MIN_PAIR`` documents on), keep weight 0.

Defined results.  A null or empty text has no terms and scores the bias.
Every input row gives one row, also without an id or with a repeated one.
An
id of several labels counts as the largest, one of several texts learns one
of them (``learning.training_rows``).  Without labelled rows every score is 0.5.  An empty table gives an empty
result.  Extra columns are ignored, as are lang, source and labels.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.base import remainder
from riskframe.llm.learning import Buckets, score_rows, sigmoid, terms, train, training_rows

BITS = 18
FACTORS = 8
SAMPLE = 20_000
MIN_DF = 4
MIN_Z = 4.0
MIN_PAIR = 8
PAIR_Z = 8.0
EPOCHS = 6
STEPS = 1000        # at least, for small samples
BATCH = 128

_buckets = Buckets(BITS)


def encode(texts: list) -> list[np.ndarray]:
    return [np.unique(_buckets.of(terms(t))) for t in texts]


def flat(xs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers, and the row of each."""
    n = [len(x) for x in xs]
    return (np.concatenate(xs) if xs else np.zeros(0, np.int32)).astype(np.int64), np.repeat(np.arange(len(xs)), n)


def row_sums(v: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(row, weights=v[:, k], minlength=n) for k in range(v.shape[1])], axis=1)


def logits(m: dict, f: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    v = m["v"][f]
    s = row_sums(v, row, n)
    pairs = 0.5 * ((s ** 2).sum(1) - np.bincount(row, weights=(v ** 2).sum(1), minlength=n))
    return m["b"] + np.bincount(row, weights=m["w"][f], minlength=n) + pairs, s, v


def paired(xs: list[np.ndarray], y: np.ndarray, p: float, some: np.ndarray) -> np.ndarray:
    """Which of the terms ``some`` are in a pair of them whose share of label
    1 differs from ``p`` by ``PAIR_Z`` standard deviations."""
    out = np.zeros(len(some), dtype=bool)
    number = np.full(len(out), -1)
    number[some] = np.arange(int(some.sum()))
    kept = [number[x][number[x] >= 0] for x in xs]
    f, row = flat(kept)
    order = np.argsort(f, kind="stable")
    rows_of = np.split(row[order], np.cumsum(np.bincount(f, minlength=int(some.sum())))[:-1])
    names = np.flatnonzero(some)
    for i, r in enumerate(rows_of):
        if len(r) < MIN_PAIR:
            continue
        other = np.concatenate([kept[k] for k in r])
        n = np.bincount(other, minlength=len(names))
        pos = np.bincount(other, weights=np.repeat(y[r], [len(kept[k]) for k in r]), minlength=len(names))
        n[i] = 0
        out[names[i]] = bool(((n >= MIN_PAIR) & (np.abs(pos - n * p) >= PAIR_Z * np.sqrt(n * p * (1 - p)))).any())
    return out


def fit(xs: list[np.ndarray], y: np.ndarray, rate: float = 0.15, decay: float = 2e-3) -> dict:
    rng = np.random.default_rng(7)
    size = 1 << BITS
    m = {"b": 0.0, "w": np.zeros(size), "v": np.zeros((size, FACTORS))}
    if not len(y):
        return m
    f, _ = flat(xs)
    # terms whose share of label 1 differs from the sample's by MIN_Z standard deviations
    df, pos = np.bincount(f, minlength=size), np.bincount(f, weights=np.repeat(y, [len(x) for x in xs]), minlength=size)
    p = (y.sum() + 1) / (len(y) + 2)
    often = (df >= MIN_DF) & (np.abs(pos - df * p) >= MIN_Z * np.sqrt(df * p * (1 - p)))
    often |= paired(xs, y, p, (df >= MIN_PAIR) & ~often)
    m["v"][often] = rng.normal(0, 0.01, (int(often.sum()), FACTORS))
    m["b"] = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    xs = [x[often[x]] for x in xs]
    gw, gv = np.full(size, 1e-2), np.full((size, FACTORS), 1e-2)
    for _ in range(max(EPOCHS, -(-STEPS * BATCH // len(y)))):
        order = rng.permutation(len(y))
        for at in range(0, len(order), BATCH):
            pick = order[at:at + BATCH]
            f, row = flat([xs[i] for i in pick])
            if not len(f):
                continue
            z, s, v = logits(m, f, row, len(pick))
            e = sigmoid(z) - y[pick]
            u, back = np.unique(f, return_inverse=True)
            dw = np.bincount(back, weights=e[row], minlength=len(u)) + decay * m["w"][u]
            dv = row_sums(e[row, None] * (s[row] - v), back, len(u)) + decay * m["v"][u]
            gw[u] += dw ** 2
            gv[u] += dv ** 2
            m["w"][u] -= rate * dw / np.sqrt(gw[u])
            m["v"][u] -= 0.1 * rate * dv / np.sqrt(gv[u])
            m["b"] -= 0.01 * float(e.mean())
    return {k: np.asarray(x, dtype=np.float32) if k != "b" else x for k, x in m.items()}


def score(m: dict, texts: list) -> np.ndarray:
    xs = encode(texts)
    f, row = flat(xs)
    return sigmoid(logits(m, f, row, len(xs))[0])


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: int = SAMPLE,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)``; rows whose crc32 remainder
    by 3 is 1 are held out from learning."""
    rows = training_rows(docs, labels, "toxic", remainder(id_col, 3) != 1, sample, id_col, text_col)
    model = train(rows, encode, fit)
    out = score_rows(docs, model, score, id_col, text_col)
    return out.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"))
