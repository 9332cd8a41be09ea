"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into two halves of 32 bits.  Fingerprints that differ
in at most 3 bits differ in at most one bit in one half, so each fingerprint
enumerates the ball of radius 1 around both halves (33 + 33 keys), fetches
the table entries under these keys and verifies complete distances.

Equal fingerprints are collapsed to one table row first, so copies never
meet in pairs.  The fingerprints under one key are compared in blocks of at
most ``BLOCK``: a large group becomes many (block, block) tasks of bounded
memory, and a task returns a spanning forest of the links it verified, not
the links, so a dense group of n fingerprints gives about n rows.

Defined results.  A null or empty text has fingerprint zero and links like
any other.  Repeated rows each get a result row.  A row without an id takes
part; ``component_id`` is the smallest id reachable, null if none has one.
An empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.base import by_group, materialise
from riskframe.llm.graph import components

SEED = 42
BLOCK = 256
HALF = (1 << 32) - 1


def fingerprint(text: bytes | None, shingle: int) -> int:
    """64 majority bits over the XXH64 of the word shingles (unsigned)."""
    import xxhash
    words = (text or b"").lower().split()       # bytes: only A-Z and ASCII spaces
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    bits = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 16):             # a very long text in slices
        h = [xxhash.xxh64_intdigest(b" ".join(words[i:i + shingle]), SEED) for i in range(at, min(n, at + (1 << 16)))]
        b = np.unpackbits(np.array(h, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        bits += b.sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(doc_id, fp)`` for every row; ``fp`` holds the 64 bits as a long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("t"))
    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(run, f"doc_id {kind}, fp long")


def forest(fp: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Edges (positions) of a spanning forest of the links of ``fp``: each
    vertex is compared once with all that are not yet reached."""
    u = fp.view(np.uint64)
    left = np.arange(len(u))
    edges: list[tuple[int, int]] = []
    while len(left):
        stack, left = [int(left[0])], left[1:]
        while stack and len(left):
            x = stack.pop()
            near = np.bitwise_count(u[left] ^ u[x]) <= max_bits
            if near.any():
                new = left[near]
                edges += [(x, int(y)) for y in new]
                stack += [int(y) for y in new]
                left = left[~near]
    return edges


def half_keys(fp, half: int):
    """The half as a long, and the ball of radius 1 around it."""
    key = F.shiftrightunsigned(fp, 32) if half else fp.bitwiseAND(F.lit(HALF))
    return key, F.array(*[key.bitwiseXOR(F.lit(1 << i)) for i in range(32)])


def near_links(table: DataFrame, max_bits: int = 3) -> DataFrame:
    """Edges ``(a, b)`` between distinct fingerprints of ``table(fp)`` that
    connect all pairs at ``max_bits`` or less (a spanning subset of them)."""
    if max_bits > 3:
        raise ValueError("two halves with balls of radius 1 find distances up to 3")
    rows = []
    for half in (0, 1):
        key, ball = half_keys(F.col("fp"), half)
        rows.append((table.select(F.lit(half).alias("half"), key.alias("key"), "fp"),
                     table.select(F.lit(half).alias("half"), F.explode(ball).alias("key"), "fp")))
    held = rows[0][0].unionByName(rows[1][0])
    probes = rows[0][1].unionByName(rows[1][1])
    keys = held.groupBy("half", "key").agg(F.count(F.lit(1)).alias("n"))
    # only probes that hit a key that some fingerprint holds go on
    hits = probes.join(keys.select("half", "key"), ["half", "key"], "left_semi")
    members = materialise(held.unionByName(hits), "simhash-members")
    sizes = members.groupBy("half", "key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    sizes = materialise(sizes, "simhash-sizes")     # a plain table, so that a skewed join can be split
    # blocks of a bounded number of members, dealt by hash; every pair of blocks meets in one task
    blocks = F.ceil(F.col("m") / F.lit(BLOCK)).cast("int")
    dealt = (members.join(sizes, ["half", "key"]).withColumn("nb", blocks)
             .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("nb")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
             .where("nb = 1 or own != other")
             .select("half", "key", "fp", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y")))

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        fp = np.unique(pdf["fp"].to_numpy(dtype=np.int64))
        e = forest(fp, max_bits)
        ix = np.array(e, dtype=np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": fp[ix[:, 0]], "b": fp[ix[:, 1]]})
    # many small groups: a task walks through its sorted groups instead of one call a group
    return dealt.repartition("half", "key", "x", "y").sortWithinPartitions("half", "key", "x", "y").mapInPandas(
        lambda it: by_group(it, ["half", "key", "x", "y"], link), "a long, b long")


def simhash_dedup(docs: DataFrame, shingle: int = 3, max_bits: int = 3,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs``."""
    rows = materialise(fingerprints(docs, id_col, text_col, shingle), "simhash-fingerprints")
    table = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-table")
    comp = components(near_links(table.select("fp"), max_bits)).withColumnRenamed("v", "fp")
    named = table.join(comp, "fp", "left").select("fp", "first", F.coalesce("comp", "fp").alias("comp"))
    named = materialise(named, "simhash-named")
    least = materialise(named.groupBy("comp").agg(F.min("first").alias("component_id")), "simhash-least")
    of = named.join(least, "comp").select("fp", "component_id")
    out = rows.join(of, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
