"""Spelling of rare words: logistic mixing of bit predictors over a word's bytes.

A word is its bytes, closed by a space, each byte 8 binary decisions.  For
each decision ``CONTEXTS`` predictors look up how often 0 and 1 followed a
hashed context: the last 1, 2, 3 or 5 bytes of the word, or the whole word
so far.  Their log odds are summed with weights that a gate selects (how
many predictors have seen their context, how often the word so far was seen,
and the bit's place); the weights are learned online, by the coding error of
each mini-batch of words.  A last table, gated the same way, refines the
mixed probability towards the rate observed where it was given.

Counts are sums over all rare training words.  Weights and the refining
table are fitted over the same words, each prediction leaving out the
occurrence it predicts, in one online pass per shard of words; a word's shard
is a hash, so the result does not depend on the number of tasks.  Without
rare training words all counts are 0 and each bit costs 1.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = 0
ORDERS = (1, 2, 3, 5, WORD)     # bytes of context; the whole word so far
CONTEXTS = len(ORDERS)
BITS = (16, 18, 20, 21, 21)     # each context's table has 2^this slots
BLOCK = 1 << 13             # slots of a block that travels as one row
SURE = np.array([1, 2, 6, 20, 100])     # steps of the whole-word predictor's count
GATES = (CONTEXTS + len(SURE)) * 8
LEVELS = 24                 # steps of the refining table
SLICE = 1 << 14             # bytes that are predicted together
RATE = 0.03


def slices(terms: list[bytes], weight: np.ndarray) -> Iterator[tuple]:
    """``(bytes, contexts, weight, word)`` for bounded slices of the words
    laid end to end, each closed by a space."""
    data = np.frombuffer(b" ".join(terms) + b" ", dtype=np.uint8)
    size = np.fromiter((len(t) + 1 for t in terms), dtype=np.int64, count=len(terms))
    first = np.cumsum(size) - size
    word = np.repeat(np.arange(len(terms)), size)
    at = np.arange(len(data)) - first[word]
    # running sums give the hash of any word's beginning
    mixed = (data.astype(np.uint64) + np.uint64(1)) * ((at.astype(np.uint64) * np.uint64(2) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    run = np.concatenate([[np.uint64(0)], np.cumsum(mixed, dtype=np.uint64)])
    contexts = []
    for i, order in enumerate(ORDERS):
        if order == WORD:
            h = run[:-1] - run[first][word] + at.astype(np.uint64)
        else:
            h = np.zeros(len(data), dtype=np.uint64)
            for k in range(1, order + 1):
                back = np.roll(data, k).astype(np.uint64)
                back[at < k] = 0
                h += back << np.uint64(8 * (k - 1))
        h = (h + np.uint64(i + 1)) * np.uint64(0xD6E8FEB86659FD93)
        contexts.append((h >> np.uint64(32)).astype(np.uint32))
    for a in range(0, len(data), SLICE):
        part = slice(a, a + SLICE)
        yield data[part], [c[part] for c in contexts], weight[word[part]], word[part]


def slots(contexts: list[np.ndarray], node: np.ndarray) -> list[np.ndarray]:
    """Table slots of the contexts at a node (the bits of the byte so far)."""
    out = []
    for c, bits in zip(contexts, BITS):
        h = (c ^ (node * np.uint32(0x85EBCA6B))) * np.uint32(0xC2B2AE35)
        out.append(((h ^ (h >> np.uint32(15))) * np.uint32(0x27D4EB2F)) >> np.uint32(32 - bits))
    return out


def decisions(data: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for j in range(8):
        yield j, (data.astype(np.uint32) >> np.uint32(8 - j)) | np.uint32(1 << j), (data >> (7 - j)) & 1


class Model:
    """Counts, mixing weights and the refining table."""

    def __init__(self, counts: list[np.ndarray]):
        # for each context: slots x (0s, 1s), the two counts of a slot as one number
        self.pairs = [c.view(np.int64) for c in counts]
        self.mix = np.full((GATES, CONTEXTS), 1 / CONTEXTS, dtype=np.float32)
        self.seen = np.zeros((GATES, LEVELS, 2))                # refining table: weight, weight of ones

    def predict(self, contexts, j, node, bit, leave_out: bool, limit: np.ndarray):
        """Log odds of each predictor and the gate.

        ``limit`` holds, per byte, how often the whole-word predictor saw
        the bits so far.  A slot with more was written by another context,
        so it is taken as unseen; ``limit`` is then brought up to date."""
        x = np.empty((CONTEXTS, len(node)), dtype=np.float32)
        known = np.zeros(len(node), dtype=np.int64)
        one = bit.astype(np.float32)
        for k, s in enumerate(slots(contexts, node)):
            n = self.pairs[k].take(s).view(np.float32)      # the two counts of a slot in one read
            n0, n1 = n[::2].copy(), n[1::2].copy()
            if ORDERS[k] == WORD:
                ok = n0 + n1 <= 1.02 * limit + 1
                n0 *= ok
                n1 *= ok
                limit[:] = np.where(bit == 1, n1, n0)
            if leave_out:
                n1 = np.maximum(n1 - one, 0)
                n0 = np.maximum(n0 - (1 - one), 0)
            both = n0 + n1
            known += both > 0
            x[k] = np.log((n1 + np.float32(0.05)) / (n0 + np.float32(0.05)))
        # the last predictor is that of the whole word: its count if it has one, else how many others have
        sure = np.searchsorted(SURE, both, side="right")
        return x, np.where(sure > 0, CONTEXTS - 1 + sure, np.minimum(known, CONTEXTS - 1)) * 8 + j

    def mixed(self, x, gate):
        return np.clip(np.einsum("kn,nk->n", x, self.mix[gate]), -16, 16)

    def refined(self, z, gate):
        p = 1 / (1 + np.exp(-z.astype(np.float64)))
        seen = self.seen[gate, level(z)]
        q = (seen[:, 1] + 20 * p) / (seen[:, 0] + 20)
        return np.clip((p + q) / 2, 1e-7, 1 - 1e-7)


def level(z: np.ndarray) -> np.ndarray:
    return np.clip(z * (LEVELS / 24) + LEVELS / 2, 0, LEVELS - 1).astype(np.int64)


def add_counts(t: list[np.ndarray], terms: list[bytes], n: np.ndarray) -> None:
    for data, ctx, w, _ in slices(terms, n):
        for _, node, bit in decisions(data):
            for k, s in enumerate(slots(ctx, node)):
                np.add.at(t[k], s.astype(np.int64) * 2 + bit, w)


def bit_counts(train: DataFrame) -> list[np.ndarray]:
    """Counts of all rare training words, summed in blocks of slots."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = [np.zeros(2 << bits) for bits in BITS]
        for b in batches:
            n = np.array(b.column(1).to_pylist(), dtype=np.float64)
            terms = b.column(0).to_pylist()
            if terms:
                add_counts(t, terms, n)
        for k in range(CONTEXTS):
            block = [(i, t[k][2 * i * BLOCK:2 * (i + 1) * BLOCK].astype("<f4")) for i in range((1 << BITS[k]) // BLOCK)]
            block = [(i, x.tobytes()) for i, x in block if x.any()]
            if block:
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(block), pa.int32()), pa.array([i for i, _ in block], pa.int32()),
                                                  pa.array([x for _, x in block], pa.binary())], names=["k", "i", "x"])

    def add(t: pa.Table) -> pa.Table:
        x = sum((np.frombuffer(v, dtype="<f4").astype(np.float64) for v in t["x"].to_pylist()), np.zeros(2 * BLOCK))
        return pa.table({"k": t["k"][:1], "i": t["i"][:1], "x": pa.array([x.astype("<f4").tobytes()], pa.binary())})
    schema = "k int, i int, x binary"
    out = [np.zeros(2 << bits, dtype=np.float32) for bits in BITS]
    for r in train.mapInArrow(run, schema).groupBy("k", "i").applyInArrow(add, schema).toLocalIterator():  # tables of fixed size
        out[r["k"]][2 * r["i"] * BLOCK:2 * (r["i"] + 1) * BLOCK] = np.frombuffer(bytes(r["x"]), dtype="<f4")
    return out


def packed(counts: list[np.ndarray]) -> list[bytes]:
    """Tables to broadcast: mostly empty ones on small inputs."""
    return [zlib.compress(c, 1) for c in counts]


def unpacked(shared) -> list[np.ndarray]:
    return [np.frombuffer(zlib.decompress(c), dtype=np.float32) for c in shared.value]


def fit_weights(train: DataFrame, shared) -> tuple[np.ndarray, np.ndarray]:
    """One online pass a shard, which is a partition; weights averaged by what they saw, the
    refining tables added up."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(unpacked(shared))
        total, past = np.zeros(GATES), np.full((GATES, CONTEXTS), 1e-4)
        for b in batches:
            n = np.array(b.column(1).to_pylist(), dtype=np.float64)
            for data, ctx, w, _ in slices(b.column(0).to_pylist(), n):
                limit = np.full(len(data), np.inf, dtype=np.float32)
                for j, node, bit in decisions(data):
                    x, gate = m.predict(ctx, j, node, bit, True, limit)
                    z = m.mixed(x, gate)
                    cell = gate * LEVELS + level(z)
                    m.seen[..., 0] += np.bincount(cell, weights=w, minlength=GATES * LEVELS).reshape(GATES, LEVELS)
                    m.seen[..., 1] += np.bincount(cell, weights=w * bit, minlength=GATES * LEVELS).reshape(GATES, LEVELS)
                    e = w * (bit - 1 / (1 + np.exp(-z)))
                    g = np.stack([np.bincount(gate, weights=e * x[k], minlength=GATES) for k in range(CONTEXTS)], axis=1)
                    c = np.bincount(gate, weights=w, minlength=GATES)
                    g /= np.maximum(c, 1)[:, None]
                    past += g ** 2
                    m.mix += (RATE * g / np.sqrt(past)).astype(np.float32)
                    total += c
        yield pa.RecordBatch.from_arrays([
            pa.array([(m.mix * total[:, None]).astype("<f8").tobytes()], pa.binary()),
            pa.array([total.astype("<f8").tobytes()], pa.binary()),
            pa.array([m.seen.astype("<f8").tobytes()], pa.binary())], names=["mix", "total", "seen"])
    schema = "mix binary, total binary, seen binary"

    def add(t: pa.Table) -> pa.Table:
        return pa.table({c: pa.array([sum(np.frombuffer(v, "<f8") for v in t[c].to_pylist()).tobytes()], pa.binary())
                         for c in ("mix", "total", "seen")})
    # partial sums in a few tasks, so that no task or driver holds a row of every partition
    part = train.mapInArrow(run, schema).withColumn("g", F.pmod(F.spark_partition_id(), F.lit(32)))
    rows = part.groupBy("g").applyInArrow(lambda t: add(t), schema).collect()
    mix, total, seen = (sum((np.frombuffer(bytes(r[c]), "<f8") for r in rows), np.zeros(n)) for c, n in (
        ("mix", GATES * CONTEXTS), ("total", GATES), ("seen", GATES * LEVELS * 2)))
    total = total.reshape(-1, 1)
    start = Model([]).mix
    return (np.where(total > 0, mix.reshape(GATES, CONTEXTS) / np.maximum(total, 1), start).astype(np.float32),
            seen.reshape(GATES, LEVELS, 2))


def word_bits(terms: DataFrame, shared, weights: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``(term, n, bits)`` for every distinct word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(unpacked(shared))
        m.mix, m.seen = weights
        for b in batches:
            t = b.column(0).to_pylist()
            bits = np.zeros(len(t))
            for data, ctx, _, word in slices(t, np.zeros(len(t))) if t else ():
                limit = np.full(len(data), np.inf, dtype=np.float32)
                for j, node, bit in decisions(data):
                    x, gate = m.predict(ctx, j, node, bit, False, limit)
                    p = m.refined(m.mixed(x, gate), gate)
                    bits += np.bincount(word, weights=-np.log2(np.where(bit == 1, p, 1 - p)), minlength=len(t))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(bits, pa.float64())], names=["term", "n", "bits"])
    return terms.select("term", "n").mapInArrow(run, "term binary, n long, bits double")
