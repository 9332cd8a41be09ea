"""What the two classifiers share: a bounded training sample, hashed terms,
and a model that travels as one row."""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskframe.llm.base import materialise

KEPT = 300_000          # terms whose bucket a worker keeps
_TERM = re.compile(r"[^\W_]+")


class Buckets:
    """Hash buckets of terms, with a bounded memory of those seen."""

    def __init__(self, bits: int):
        self.mask, self.kept = (1 << bits) - 1, {}

    def of(self, terms) -> np.ndarray:
        kept = self.kept
        if len(kept) > KEPT:
            kept.clear()
        out = []
        for t in terms:
            b = kept.get(t)
            if b is None:
                b = zlib.crc32(t if isinstance(t, bytes) else t.encode()) & self.mask
                if len(t) <= 64:
                    kept[t] = b
            out.append(b)
        return np.array(out, dtype=np.int32)


def terms(text: bytes | None) -> set[str]:
    return set(_TERM.findall((text or b"").decode("utf-8", "replace").lower()))


#: Bytes of text that a training sample holds, at most.
SAMPLE_BYTES = 256 << 20


def training_rows(docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(h, y, t)`` of at most ``rows`` labelled documents that ``learn``
    allows, with at most ``SAMPLE_BYTES`` of text: those with the smallest
    hash of the id, as long as their texts fit.  An id is one row: its label
    is the largest that is given for it, its text the one of the smallest
    hash (an id may be repeated on any number of rows).  The ids are a
    bounded table, so only texts of the sample are shuffled."""
    ids = (labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & learn)
           .groupBy(F.col(id_col).alias("_id")).agg(F.max(label).cast("int").alias("y"))
           .orderBy(F.xxhash64("_id"), "_id").limit(rows))
    d = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("t"))
    size = F.struct(F.xxhash64("t").alias("k"), F.coalesce(F.octet_length("t"), F.lit(0)).alias("n"))
    some = d.join(F.broadcast(ids), "_id").groupBy("_id", "y").agg(F.min(size).alias("s"))
    # a running sum over at most `rows` numbers
    w = W.partitionBy(F.lit(0)).orderBy(F.xxhash64("_id"), "_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    fit = some.withColumn("_sum", F.sum("s.n").over(w)).where(F.col("_sum") <= SAMPLE_BYTES).select("_id", "y", F.col("s.k").alias("k"))
    fit = materialise(fit, "training-ids")
    one = d.withColumn("k", F.xxhash64("t")).join(F.broadcast(fit), ["_id", "k"])
    return one.groupBy("_id", "y").agg(F.min("t").alias("t")).select(F.xxhash64("_id").alias("h"), "y", "t")


def train(sample: DataFrame, encode: Callable[[list], list], fit: Callable[[list, np.ndarray], object]):
    """Encode the sample where it lies, fit in one task (the sample is
    bounded), and return the fitted model (bounded as well)."""
    def enc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [pickle.dumps(e) for e in encode(b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x, pa.binary())], names=["h", "y", "x"])

    def one(t: pa.Table) -> pa.Table:
        t = t.sort_by([("h", "ascending")])     # the same order whatever the partitions were
        model = fit([pickle.loads(x) for x in t["x"].to_pylist()], np.array(t["y"].to_pylist(), dtype=np.float64))
        return pa.table({"model": pa.array([pickle.dumps(model)], pa.binary())})
    coded = sample.mapInArrow(enc, "h long, y int, x binary")
    got = coded.withColumn("g", F.lit(1)).groupBy("g").applyInArrow(one, "model binary").collect()
    return pickle.loads(bytes(got[0][0])) if got else fit([], np.array([]))


def score_rows(docs: DataFrame, model, score: Callable[[object, list], np.ndarray],
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score)`` for every row, in one pass without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("t"))
    kind = d.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                s = score(m, part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])
    return d.mapInArrow(run, f"doc_id {kind}, score double")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))
