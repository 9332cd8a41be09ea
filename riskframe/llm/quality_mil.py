"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words.  A passage is encoded
as the mean embedding of its hashed words and word shapes with a few ratios;
gated attention (tanh times sigmoid, then a softmax over the bag) weights
the passages, and the weighted mean gives the document's score.  Embeddings,
attention and output are learned together from document labels alone, on a
bounded sample of labelled rows (``SAMPLE``).

Defined results.  A null or empty text is one empty passage.  Every input
row gives one row, also without an id or with a repeated one.  An
id of several labels counts as the largest, one of several texts learns one
of them (``learning.training_rows``).  Without
labelled rows every score is 0.5.  An empty table gives an empty result.
Extra columns are ignored, as are lang, source and labels.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.base import remainder
from riskframe.llm.learning import Buckets, score_rows, sigmoid, train, training_rows

PASSAGE = 64
BITS = 15
DIM = 12
HIDDEN = 8
RATIOS = 4
SAMPLE = 8_000
EPOCHS = 6
BATCH = 32
LETTERS = bytes(range(97, 123)) + bytes(range(48, 58)) + bytes(range(128, 256))

_buckets = Buckets(BITS)
_shapes = Buckets(BITS)


def encode(texts: list) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per document: buckets of words and shapes (side by side), passage
    lengths in words, and the passages' ratios."""
    out = []
    for t in texts:
        raw = (t or b"").split()
        low = (t or b"").lower().split()
        words = _buckets.of(low)
        # a shape is what is left of a word without letters and digits
        shapes = _shapes.of([w.translate(None, LETTERS) for w in low])
        cuts = list(range(0, max(1, len(low)), PASSAGE))
        ratio = np.zeros((len(cuts), RATIOS), dtype=np.float32)
        for i, a in enumerate(cuts):
            w, r = low[a:a + PASSAGE], raw[a:a + PASSAGE]
            if w:
                ratio[i] = (1 - len(set(w)) / len(w), sum(map(len, w)) / len(w) / 8,
                            sum(x.isupper() for x in r) / len(r), len(w) / PASSAGE)
        n = np.array([len(low[a:a + PASSAGE]) for a in cuts], dtype=np.int64)
        out.append((np.stack([words, shapes], axis=1) if len(low) else np.zeros((0, 2), np.int32), n, ratio))
    return out


def forward(m: dict, bags: list) -> dict:
    ids = np.concatenate([b[0] for b in bags]).astype(np.int64)
    n = np.concatenate([b[1] for b in bags])
    ratio = np.concatenate([b[2] for b in bags]).astype(np.float64)
    per = [len(b[1]) for b in bags]
    bag = np.repeat(np.arange(len(bags)), per)
    e = m["e"][ids[:, 0]] + m["e2"][ids[:, 1]]
    of = np.repeat(np.arange(len(n)), n)
    mean = np.stack([np.bincount(of, weights=e[:, k], minlength=len(n)) for k in range(DIM)], axis=1) / np.maximum(n, 1)[:, None]
    h = np.concatenate([mean, ratio], axis=1)
    t, g = np.tanh(h @ m["V"]), sigmoid(h @ m["U"])
    a = (t * g) @ m["w"]
    top = np.full(len(bags), -np.inf)
    np.maximum.at(top, bag, a)
    x = np.exp(a - top[bag])
    alpha = x / np.bincount(bag, weights=x, minlength=len(bags))[bag]
    z = np.stack([np.bincount(bag, weights=alpha * h[:, k], minlength=len(bags)) for k in range(h.shape[1])], axis=1)
    return {"ids": ids, "n": n, "of": of, "bag": bag, "h": h, "t": t, "g": g, "alpha": alpha, "z": z,
            "p": sigmoid(z @ m["c"] + m["b"])}


def fit(bags: list, y: np.ndarray, rate: float = 0.05) -> dict:
    rng = np.random.default_rng(11)
    d = DIM + RATIOS
    m = {"e": rng.normal(0, 0.05, (1 << BITS, DIM)), "e2": rng.normal(0, 0.05, (1 << BITS, DIM)),
         "V": rng.normal(0, 0.3, (d, HIDDEN)), "U": rng.normal(0, 0.3, (d, HIDDEN)),
         "w": rng.normal(0, 0.3, HIDDEN), "c": rng.normal(0, 0.1, d), "b": np.zeros(1)}
    if not len(y):
        m["c"][:] = 0
        return m
    acc = {k: np.full_like(v, 1e-3) for k, v in m.items()}

    def step(k: str, g: np.ndarray, rows=slice(None)) -> None:
        acc[k][rows] += g ** 2
        m[k][rows] -= rate * g / np.sqrt(acc[k][rows])
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(order), BATCH):
            pick = order[at:at + BATCH]
            f = forward(m, [bags[i] for i in pick])
            err = (f["p"] - y[pick]) / len(pick)
            bag, h, alpha = f["bag"], f["h"], f["alpha"]
            dz = err[:, None] * m["c"]
            # through the weighted mean and the softmax over each bag
            dh = alpha[:, None] * dz[bag]
            da = (h * dz[bag]).sum(1)
            da = alpha * (da - np.bincount(bag, weights=alpha * da, minlength=len(pick))[bag])
            tg = da[:, None] * m["w"]
            dt, dg = tg * f["g"] * (1 - f["t"] ** 2), tg * f["t"] * f["g"] * (1 - f["g"])
            dh += dt @ m["V"].T + dg @ m["U"].T
            de = dh[:, :DIM] / np.maximum(f["n"], 1)[:, None]
            grads = {"c": f["z"].T @ err + 1e-4 * m["c"], "b": np.array([err.sum()]), "V": h.T @ dt, "U": h.T @ dg,
                     "w": (f["t"] * f["g"]).T @ da}
            for k, col in (("e", 0), ("e2", 1)):
                u, back = np.unique(f["ids"][:, col], return_inverse=True)
                if len(u):
                    step(k, np.stack([np.bincount(back, weights=de[f["of"], j], minlength=len(u)) for j in range(DIM)], axis=1)
                         + 1e-6 * m[k][u], u)
            for k, g in grads.items():
                step(k, g)
    return m


def score(m: dict, texts: list) -> np.ndarray:
    """In slices of bounded size; a very long text stands alone."""
    out, part, words = [], [], 0
    for b in encode(texts):
        part.append(b)
        words += len(b[0])
        if words > 100_000:
            out.append(forward(m, part)["p"])
            part, words = [], 0
    if part:
        out.append(forward(m, part)["p"])
    return np.concatenate(out) if out else np.zeros(0)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: int = SAMPLE,
            id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)``; rows whose crc32 remainder
    by 4 is 2 are held out from learning."""
    rows = training_rows(docs, labels, "quality", remainder(id_col, 4) != 2, sample, id_col, text_col)
    model = train(rows, encode, fit)
    out = score_rows(docs, model, score, id_col, text_col)
    return out.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"))
