"""Benchmark decontamination: hashed item windows, scanned over all texts.

Every item of a benchmark is cut into windows of ``size`` words (an item of
fewer words, but not none, is one window).  The windows' 64-bit hashes are
broadcast; each task rolls the same hash over its texts' words, looks the
hashes up and compares the words themselves, so a collision never counts.
A document's words inside any occurrence of a window are hit; the hits come
as spans of the text, which ``remove_spans`` and ``remove_documents`` use.

Words: ASCII letters (A-Z as a-z) and digits, and all other characters from
U+0080 on; in UTF-8 that is a matter of single bytes, so words, their hashes
and windows are found for a whole batch of texts by array operations.

The windows are collected and broadcast in parts of at most ``PART`` bytes
of words; a larger benchmark takes several scans in a row over the same
texts, each adding its hits, all in one stage without a shuffle.

Defined results.  Null and empty texts have no words and no hits.  Null items
and items without words have no windows; rows of equal item id are one item
in the results, also with different texts; a null item id is never listed.
Repeated documents are each scanned.  Columns of ``docs`` stay; those that
the operator adds replace existing ones of the same names.  An empty table
gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of an item, and of a text, once lowered.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Bytes of window words that one scan broadcasts.
PART = 64 << 20
#: Bytes of text that are worked on at a time (a longer text alone).
STEP = 2 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[65:91] = _IS_WORD[128:] = True
# odd, so it has an inverse modulo 2^64
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)
_MIX = np.uint64(0xD6E8FEB86659FD93)
#: Bits of the first look-up.
_BITS = 22


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each word of the lowered bytes, from
    prefix sums over pieces of the bytes."""
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        lo = int(starts[at])
        to = max(int(np.searchsorted(ends, lo + STEP, "right")), at + 1)
        hi = int(ends[to - 1])
        room = STEP if hi - lo <= STEP else hi - lo
        sums = np.zeros(hi - lo + 1, dtype=np.uint64)
        np.cumsum((data[lo:hi].astype(np.uint64) + np.uint64(1)) * _powers(_BASE, room)[:hi - lo], out=sums[1:])
        s, e = starts[at:to] - lo, ends[at:to] - lo
        out[at:to] = _mixed((sums[e] - sums[s]) * _powers(_UNBASE, room)[s])
        at = to
    return out


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of ``size`` words, by where it starts."""
    n = max(0, len(words) - size + 1)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        out = out * np.uint64(_BASE) + words[k:k + n]
    return _mixed(out + np.uint64(size))


class Windows:
    """Windows of items, by hash: what one scan looks up."""

    def __init__(self, of: dict[tuple[bytes, ...], list[str]]):
        self.words = list(of)
        self.items = [sorted(set(v)) for v in of.values()]
        self.sizes = sorted({len(w) for w in self.words})
        self.tables = {}
        for n in self.sizes:
            ids = np.array([i for i, w in enumerate(self.words) if len(w) == n])
            hashed = np.array([window_hashes(_hashed(self.words[i]), n)[0] for i in ids], dtype=np.uint64)
            order = np.argsort(hashed, kind="stable")
            seen = np.zeros(1 << _BITS, dtype=bool)
            seen[hashed >> np.uint64(64 - _BITS)] = True
            self.tables[n] = hashed[order], ids[order], seen

    def found(self, words: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """``(starts, windows)`` whose hashes agree within a document."""
        hashed, ids, seen = self.tables[size]
        h = window_hashes(words, size)
        at = np.flatnonzero(seen[h >> np.uint64(64 - _BITS)])
        at = at[doc[at] == doc[at + size - 1]]
        lo, hi = np.searchsorted(hashed, h[at], "left"), np.searchsorted(hashed, h[at], "right")
        n = hi - lo
        first = np.repeat(lo - (np.cumsum(n) - n), n)
        return np.repeat(at, n), ids[first + np.arange(n.sum())]


def _hashed(words: tuple[bytes, ...]) -> np.ndarray:
    data = np.frombuffer(b" ".join(words), dtype=np.uint8)
    n = np.array([len(w) for w in words])
    ends = np.cumsum(n + 1) - 1
    return word_hashes(data, ends - n, ends)


def split_words(text: str) -> list[bytes]:
    return WORD.findall(_LOWER[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)].tobytes())


def window_parts(items: DataFrame, size: int, item_col: str = "item_id", text_col: str = "text") -> Iterator[Windows]:
    """The benchmark's windows in parts of bounded size, one at a time (as the
    rows, of which the driver holds one partition); windows of equal words
    are one within a part."""
    rows = items.where(F.col(text_col).isNotNull()).select(F.col(item_col).cast("string"), text_col)
    now, room = {}, PART
    for item, text in rows.toLocalIterator():
        words = split_words(text)
        for i in range(max(1, len(words) - size + 1) if words else 0):
            w = tuple(words[i:i + size])
            if w not in now:
                room -= sum(map(len, w)) + 60 * len(w)      # with what Python adds to each
            now.setdefault(w, []).extend([item] if item is not None else [])
            room -= 60
            if room < 0:
                yield Windows(now)
                now, room = {}, PART
    if now or room == PART:
        yield Windows(now)


def _scan(text: pa.Array, windows: Windows) -> tuple[np.ndarray, dict[int, tuple[list, set]]]:
    """Words of each text, and for those with hits ``(spans, items)``: the
    hit words as ``(byte start, byte end)``, and the ids."""
    off = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset:text.offset + len(text) + 1]
    raw = text.buffers()[2]
    raw = np.frombuffer(raw, dtype=np.uint8)[off[0]:off[-1]] if raw is not None else np.zeros(0, np.uint8)
    off = off - off[0]
    data, word = _LOWER[raw], _IS_WORD[raw]
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[off] = True                        # words do not cross texts
    before = np.concatenate([[False], word[:-1]]) if len(word) else word
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.concatenate([word[1:], [False]]) if len(word) else word
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    cut = np.searchsorted(starts, off)
    n_words, out = np.diff(cut), {}
    if not len(starts):
        return n_words, out
    doc = np.repeat(np.arange(len(text)), n_words)
    hashes = word_hashes(data, starts, ends)
    hit: dict[int, tuple[list, set]] = {}
    for size in windows.sizes:
        for at, w in zip(*(x.tolist() for x in windows.found(hashes, doc, size))):
            if all(data[starts[at + k]:ends[at + k]].tobytes() == x for k, x in enumerate(windows.words[w])):
                mine = hit.setdefault(int(doc[at]), ([], set()))
                mine[0].append((at, at + size))
                mine[1].update(windows.items[w])
    for d, (runs, items) in hit.items():
        words = np.unique(np.concatenate([np.arange(a, b) for a, b in runs]))
        out[d] = [(int(starts[i] - off[d]), int(ends[i] - off[d])) for i in words], items
    return n_words, out


def find_contamination(docs: DataFrame, items: DataFrame, size: int = 10, text_col: str = "text",
                       item_col: str = "item_id") -> DataFrame:
    """``docs`` with ``n_words``, ``hits`` (``array<struct<start,end>>``: the
    hit words, code points, end exclusive) and ``items`` (the ids, as
    strings, ascending, of items with occurring windows)."""
    spark = docs.sparkSession
    own = [c for c in docs.columns if c not in ("n_words", "hits", "items")]
    if text_col not in own:
        raise ValueError(f"{text_col} is a column that the operator adds")
    out = docs.select(*own, F.lit(0).cast("long").alias("n_words"), F.expr("array()").cast("array<struct<start:int,end:int>>").alias("hits"),
                      F.expr("array()").cast("array<string>").alias("items"))
    schema = out.schema
    for windows in window_parts(items, size, item_col):
        shared = spark.sparkContext.broadcast(windows)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                column = batch.column(own.index(text_col)).cast(pa.large_string())
                for lo, hi in _steps(column):
                    yield _add(batch.slice(lo, hi - lo), column.slice(lo, hi - lo), shared.value)
        out = out.mapInArrow(run, schema)
    return out


def _steps(text: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``STEP`` bytes."""
    off = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset:text.offset + len(text) + 1]
    lo = 0
    while lo < len(text):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + STEP, "right")) - 1)
        yield lo, hi
        lo = hi


def _add(batch: pa.RecordBatch, text: pa.Array, windows: Windows) -> pa.RecordBatch:
    n_words, found = _scan(text, windows)
    k = batch.schema.get_field_index("n_words")
    columns = list(batch.columns)
    columns[k] = pa.array(n_words, pa.int64())
    if found:
        hits, items = columns[k + 1].to_pylist(), columns[k + 2].to_pylist()
        for d, (spans, ids) in found.items():
            raw = text[d].as_py().encode("utf-8", "surrogatepass")
            # byte to code point: bytes that do not continue a character
            at = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
            new = {(int(at[a - 1]) if a else 0, int(at[b - 1])) for a, b in spans}
            hits[d] = [{"start": a, "end": b} for a, b in sorted(new | {(h["start"], h["end"]) for h in hits[d]})]
            items[d] = sorted(ids.union(items[d]), key=lambda s: s.encode())
        columns[k + 1], columns[k + 2] = (pa.array(v, columns[k + 1 + i].type) for i, v in enumerate((hits, items)))
    return pa.RecordBatch.from_arrays(columns, schema=batch.schema)


def remove_documents(found: DataFrame) -> DataFrame:
    """Without the documents that have hits."""
    return found.where(F.size("hits") == 0).drop("n_words", "hits", "items")


def remove_spans(found: DataFrame, text_col: str = "text") -> DataFrame:
    """With the hit words cut from the texts."""
    def step(acc, h):
        return F.struct((h["end"]).alias("at"), F.concat(acc["out"], F.substring(
            F.col(text_col), acc["at"] + 1, h["start"] - acc["at"])).alias("out"))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    cut = F.aggregate("hits", start, step, lambda a: F.concat(a["out"], F.substring(
        F.col(text_col), a["at"] + 1, F.length(text_col))))
    return found.withColumn(text_col, F.when(F.size("hits") == 0, F.col(text_col)).otherwise(cut)).drop("n_words", "hits", "items")


def item_digest(items: Column) -> Column:
    return F.sha2(F.array_join(items, ","), 256)
