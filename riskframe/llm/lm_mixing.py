"""LM scoring: logistic mixing of hashed-context bit predictors over running text.

A text is its lower-cased words, then an end word, coded in order.  A word
with at least 1 / ``HEAD`` of all training occurrences (two at least) has a
Huffman code; all others share one escape symbol and are then spelled
(``spelling``).  Every bit of a code is predicted by ``PREDICTORS`` contexts:
none, the previous word, and the two previous words.  Each looks up how often
0 and 1 followed its hashed context at this place of the code.  Their log odds
are summed with weights that a gate selects (how often the two longer contexts
were seen, and the bit's depth).  A last table, gated the same way, refines
the mixed probability towards the rate observed where it was given.  Weights
and table adapt online: once a mini-batch of words is coded, they learn from
the bits of training texts.

Passages that the corpus holds elsewhere are found at anchors: places whose
last ``ANCHOR`` words hash to 0 modulo ``EVERY``.  The words up to the next
anchor are a segment.  It costs ``-log2(q * share + (1 - q) * p)`` bits: p is
its probability by the bits above, share that of this segment among those
that follow the same anchor in training texts, and q the rate, learned by how
often the anchor was seen, at which a segment was seen behind it before.

The bits of a text add up to its log10 probability.  Word counts, anchors and
segments are tables that grow with the corpus; the hashed contexts' tables
have 8 slots a training word up to 2^``MOST_BITS``.  All of them cover all
training texts.  Predictions for a training text leave out the occurrence
they predict; bits, anchors and segments of held-out texts leave out nothing.

Texts are coded in shards of about ``SHARD`` training words (2^16 shards at
most); each shard adapts from the same start.  A text's shard and its place
there are a hash of its id and text, so results do not depend on the number
of tasks.

Defined results.  A null or empty text is the end word alone.  Every input
row gives one row, also without an id (held out) or with a repeated one.
Without training rows every word is spelled at 1 for each bit.  An empty
table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm import spelling
from riskframe.llm.base import materialise, remainder
from riskframe.llm.terms import HEAD, term_counts

END = b"\n"                 # the end word: no word holds it
RARE = 1 << 20              # rare words are told apart as contexts by a hash of this range
PREDICTORS = 3
HASHED = PREDICTORS - 1     # the first predictor counts per place of the code, exactly
MOST_BITS = 21              # a hashed context's table has at most 2^this slots
BLOCK = 1 << 13             # slots of a block that travels as one row
SEEN = (1, 3, 20)                       # steps of a context's count
DEPTH = np.array([1, 4, 8])             # steps of a bit's place in the code
GATES = 64
LEVELS = 24                 # steps of the refining table
SLICE = 1 << 12             # words that are predicted together
GROUP = 1 << 17             # words of texts that are held at a time (one text may be longer)
RATE = 0.03
SHARD = 1 << 22
ANCHOR, EVERY = 4, 32
ODD = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split() + [END]


class Code:
    """A Huffman code: symbol s takes the decisions ``bits`` at the places
    ``nodes``, both from ``start[s]`` to ``start[s + 1]``."""

    def __init__(self, n: list[int]):
        k = len(n)
        heap = [(c, i) for i, c in enumerate(n)]
        heapq.heapify(heap)
        up, side = np.zeros(2 * k - 1, dtype=np.int64), np.zeros(2 * k - 1, dtype=np.uint8)
        for place in range(k, 2 * k - 1):
            (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
            up[i] = up[j] = place
            side[j] = 1
            heapq.heappush(heap, (a + b, place))
        at, sym, levels = np.arange(k), np.arange(k), []
        while k > 1 and len(sym):
            levels.append((sym, up[at] - k, side[at]))
            at = up[at]
            on = at < 2 * k - 2
            at, sym = at[on], sym[on]
        size = np.zeros(k, dtype=np.int64)
        for s, _, _ in levels:
            size[s] += 1
        self.start = np.concatenate([[0], np.cumsum(size)])
        self.nodes = np.zeros(self.start[-1], dtype=np.uint32)
        self.bits = np.zeros(self.start[-1], dtype=np.uint8)
        self.depth = np.zeros(self.start[-1], dtype=np.uint8)
        for back, (s, node, bit) in enumerate(levels):     # from the leaves up
            place = self.start[s + 1] - 1 - back
            self.nodes[place], self.bits[place] = node, bit
            self.depth[place] = np.searchsorted(DEPTH, size[s] - 1 - back, side="right")
        self.places = max(1, k - 1)

    def expand(self, sym: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``nodes`` of all the symbols' decisions, and whose each is."""
        size = self.start[sym + 1] - self.start[sym]
        word = np.repeat(np.arange(len(sym)), size)
        return np.arange(len(word)) + (self.start[sym] - (np.cumsum(size) - size))[word], word


def contexts(ids: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
    """Hashes of the hashed predictors' contexts, per word; ``place`` is the
    word's number in its text."""
    x = ids.astype(np.uint64) + np.uint64(1)
    last = np.where(place >= 1, np.roll(x, 1), np.uint64(0))
    before = np.where(place >= 2, np.roll(x, 2), np.uint64(0))
    out = []
    for k, h in enumerate((last, last * ODD + before)):
        h = (h + np.uint64(k + 1)) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(29))) * ODD
        out.append((h >> np.uint64(32)).astype(np.uint32))
    return out


def slot(context: np.ndarray, node: np.ndarray, bits: int) -> np.ndarray:
    h = (context ^ (node * np.uint32(0x85EBCA6B))) * np.uint32(0xC2B2AE35)
    return ((h ^ (h >> np.uint32(15))) * np.uint32(0x27D4EB2F)) >> np.uint32(32 - bits)


def level(z: np.ndarray) -> np.ndarray:
    return np.clip(z * np.float32(LEVELS / 24) + np.float32(LEVELS / 2), 0, LEVELS - 1).astype(np.int32)


class Mixer:
    """Counts, mixing weights and the refining table."""

    def __init__(self, code: Code, counts: list[np.ndarray]):
        self.code = code
        self.pairs = [c.view(np.int64) for c in counts]     # the two counts of a slot as one number
        self.bits = [int(len(c) // 2).bit_length() - 1 for c in counts]
        self.mix = np.full((PREDICTORS, GATES), 1 / PREDICTORS, dtype=np.float32)
        self.seen = np.zeros((2, GATES * LEVELS), dtype=np.float32)     # refining table: weight, weight of ones
        self.past = np.full((PREDICTORS, GATES), 1e-4)

    def predict(self, node, bit, depth, context, own):
        """Log odds of each predictor, and the gate.  ``own`` is 1 where the
        counts hold the bit itself."""
        x = np.empty((PREDICTORS, len(node)), dtype=np.float32)
        gate = depth.copy()
        own1 = own * bit
        own0 = own - own1
        for k in range(PREDICTORS):
            at = node if k == 0 else slot(context[k - 1], node, self.bits[k])
            n = self.pairs[k].take(at).view(np.uint32)
            n0, n1 = n[::2].astype(np.float32) - own0, n[1::2].astype(np.float32) - own1
            x[k] = np.log((n1 + np.float32(0.05)) / (n0 + np.float32(0.05)))
            if k:
                n0 += n1
                for least in SEEN:
                    gate += (n0 >= least).view(np.uint8) * np.uint8(4 ** k)
        return x, gate

    def mixed(self, x, gate):
        z = self.mix[0].take(gate) * x[0]
        for k in range(1, PREDICTORS):
            z += self.mix[k].take(gate) * x[k]
        return np.clip(z, -16, 16)

    def refined(self, z, gate):
        """The mixed and the refined probability of a 1, and the refining table's cell."""
        p = 1 / (1 + np.exp(-z))
        cell = gate * np.int32(LEVELS) + level(z)
        q = (self.seen[1].take(cell) + 20 * p) / (self.seen[0].take(cell) + 20)
        return p, np.clip((p + q) / 2, np.float32(1e-7), np.float32(1 - 1e-7)), cell

    def learn(self, x, gate, bit, p, cell, own):
        """One step against the coding error of a mini-batch, over the bits that ``own`` marks."""
        if not own.any():
            return
        self.seen[0] += np.bincount(cell, weights=own, minlength=GATES * LEVELS)
        self.seen[1] += np.bincount(cell, weights=own * bit, minlength=GATES * LEVELS)
        e = (bit - p) * own
        n = np.maximum(np.bincount(gate, weights=own, minlength=GATES), 1)
        for k in range(PREDICTORS):
            g = np.bincount(gate, weights=e * x[k], minlength=GATES) / n
            self.past[k] += g ** 2
            self.mix[k] += (RATE * g / np.sqrt(self.past[k])).astype(np.float32)

    def code_texts(self, ids: np.ndarray, place: np.ndarray, own: np.ndarray) -> np.ndarray:
        """The bits of each word; learns from the words that ``own`` marks."""
        out = np.zeros(len(ids))
        for node, bit, depth, ctx, word in slices(self.code, ids, place):
            if len(word):
                mine = own.take(word)
                x, gate = self.predict(node, bit, depth, ctx, mine)
                p, q, cell = self.refined(self.mixed(x, gate), gate)
                got = np.bincount(word - word[0], weights=-np.log2(np.abs(q - (1 - bit).astype(np.float32))))
                out[word[0]:word[0] + len(got)] += got
                self.learn(x, gate, bit, p, cell, mine)
        return out


def slices(code: Code, ids: np.ndarray, place: np.ndarray) -> Iterator[tuple]:
    """``(node, bit, depth, contexts, word)`` for the bits of bounded slices of words."""
    escape = len(code.start) - 2        # ids of rare words mean the last symbol
    for a in range(0, len(ids), SLICE):
        back = max(0, a - 2)
        part = ids[back:a + SLICE]
        at, word = code.expand(np.minimum(part[a - back:], escape))
        ctx = [c[a - back:].take(word) for c in contexts(part, place[back:a + SLICE])]
        yield code.nodes.take(at), code.bits.take(at), code.depth.take(at), ctx, word + a


def texts(batch: pa.RecordBatch) -> Iterator[tuple]:
    """``(rows, ids, place, size)`` for groups of a batch's texts: the rows, the
    word ids of their texts end to end, each word's number in its text, and
    the texts' lengths."""
    first, part, held = 0, [], 0
    packed = batch.column("ids")

    def out(end: int) -> tuple:
        size = np.fromiter((len(x) // 3 for x in part), dtype=np.int64, count=len(part))
        raw = np.zeros((int(size.sum()), 4), dtype=np.uint8)
        raw[:, :3] = np.frombuffer(b"".join(part), dtype=np.uint8).reshape(-1, 3)
        place = (np.arange(len(raw)) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)
        return batch.slice(first, end - first), raw.view("<u4").ravel().astype(np.int32), place, size
    for i in range(batch.num_rows):
        part.append(zlib.decompress(packed[i].as_py()))
        held += len(part[-1]) // 3
        if held >= GROUP:
            yield out(i + 1)
            first, part, held = i + 1, [], 0
    if part:
        yield out(batch.num_rows)


def encode(docs: DataFrame, head: Broadcast, shards: int) -> DataFrame:
    """Texts as word ids, in their shards: ``(rid, doc_id, w, key, shard,
    n_bytes, n_tokens, known, base, ids, rest)``; known and base are sums
    over head words, rest holds the other words."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    d = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "w",
                    F.xxhash64("doc_id", "t").alias("key"), F.coalesce("t", F.lit(b"")).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, base = head.value
        k = len(names)

        class Numbers(dict):
            def __missing__(self, x: bytes) -> int:
                return k + zlib.crc32(x) % RARE
        number = Numbers((x, i) for i, x in enumerate(names))
        for b in batches:
            cols: list[list] = [[] for _ in range(6)]
            for t in b.column("t").to_pylist():
                words = words_of(t)
                ids = np.fromiter(map(number.__getitem__, words), dtype="<u4", count=len(words))
                common = ids[ids < k]
                rest = [words[i] for i in np.flatnonzero(ids >= k)]
                packed = zlib.compress(ids.view(np.uint8).reshape(-1, 4)[:, :3].tobytes(), 1)
                values = (len(t), len(ids), float(len(common)), float(base[common].sum()), packed, zlib.compress(b" ".join(rest), 1))
                for c, v in zip(cols, values):
                    c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in ("rid", "doc_id", "w", "key")] + [pa.array(c, t) for c, t in zip(cols, kinds)],
                names=["rid", "doc_id", "w", "key", "n_bytes", "n_tokens", "known", "base", "ids", "rest"])
    rows = d.mapInArrow(run, f"rid long, doc_id {kind}, w boolean, key long, n_bytes long, n_tokens long, "
                             "known double, base double, ids binary, rest binary")
    return (rows.repartition(shards, "key").withColumn("shard", F.pmod(F.hash("key"), F.lit(shards)))
            .sortWithinPartitions("key", "rid"))


def bit_counts(train: DataFrame, code: Broadcast, bits: int, tasks: int) -> list[np.ndarray]:
    """How often 0 and 1 followed each context, over all training texts: the
    first predictor's per place of the code, the others' per slot."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = code.value
        words = np.zeros(len(c.start) - 1, dtype=np.int64)
        t = [np.zeros(2 << bits, dtype=np.uint32) for _ in range(HASHED)]
        for b in batches:
            for _, ids, place, _ in texts(b):
                words += np.bincount(np.minimum(ids, len(words) - 1), minlength=len(words))
                for node, bit, _, ctx, _ in slices(c, ids, place):
                    for k in range(HASHED):
                        np.add.at(t[k], slot(ctx[k], node, bits).astype(np.int64) * 2 + bit, np.uint32(1))
        size = np.diff(c.start)
        exact = np.bincount(c.nodes.astype(np.int64) * 2 + c.bits, weights=np.repeat(words, size), minlength=2 * c.places)
        for k, x in enumerate([exact.astype(np.uint32), *t]):
            block = [(i, x[a:a + 2 * BLOCK]) for i, a in enumerate(range(0, len(x), 2 * BLOCK))]
            block = [(i, zlib.compress(y.tobytes(), 1)) for i, y in block if y.any()]
            if block:
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(block), pa.int32()), pa.array([i for i, _ in block], pa.int32()),
                                                  pa.array([y for _, y in block], pa.binary())], names=["k", "i", "x"])

    def add(t: pa.Table) -> pa.Table:
        x = sum(np.frombuffer(zlib.decompress(v), dtype=np.uint32).astype(np.uint64) for v in t["x"].to_pylist())
        x = np.minimum(x, np.uint64(2 ** 32 - 1)).astype(np.uint32)
        return pa.table({"k": t["k"][:1], "i": t["i"][:1], "x": pa.array([zlib.compress(x.tobytes(), 1)], pa.binary())})
    schema = "k int, i int, x binary"
    out = [np.zeros(2 * code.value.places, dtype=np.uint32)] + [np.zeros(2 << bits, dtype=np.uint32) for _ in range(HASHED)]
    # sums of whole numbers: the tasks' number only says how many tables travel
    rows = train.select("ids").coalesce(tasks).mapInArrow(run, schema).groupBy("k", "i").applyInArrow(add, schema)
    for r in rows.toLocalIterator():        # tables of bounded size
        x = np.frombuffer(zlib.decompress(bytes(r["x"])), dtype=np.uint32)
        out[r["k"]][2 * r["i"] * BLOCK:2 * r["i"] * BLOCK + len(x)] = x
    return out


def unpacked(shared: Broadcast) -> list[np.ndarray]:
    return [np.frombuffer(zlib.decompress(c), dtype=np.uint32) for c in shared.value]


def segments(ids: np.ndarray, place: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """``(text, anchor, segment, first, end)`` of each anchor: hashes of the
    words that end there and of those up to the next anchor or the text's end,
    which lie from ``first`` to before ``end``."""
    with np.errstate(over="ignore"):
        g = (ids.astype(np.uint64) + np.uint64(1)) * ODD
        g = (g ^ (g >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        h = np.zeros(len(g), dtype=np.uint64)
        for k in range(ANCHOR - 1, -1, -1):
            h = h * np.uint64(0xBF58476D1CE4E5B9) + np.roll(g, k)
        h = (h ^ (h >> np.uint64(30))) * ODD
    text = np.repeat(np.arange(len(size)), size)
    last = (np.cumsum(size) - 1)[text]
    found = np.flatnonzero((place >= ANCHOR - 1) & ((h >> np.uint64(40)) % np.uint64(EVERY) == 0) & (np.arange(len(g)) < last))
    first = found + 1
    end = np.append(found[1:] + 1, 0)
    own_end = last[found] + 1
    end = np.where((end == 0) | (end > own_end), own_end, end)
    # words are told apart by their distance to the anchor: each is rolled on by the words behind it
    with np.errstate(over="ignore"):
        inside = np.repeat(np.arange(len(found)), end - first)
        step = np.arange(len(inside)) - np.repeat(np.cumsum(end - first) - (end - first), end - first)
        y = (g[first[inside] + step] ^ ((step.astype(np.uint64) + np.uint64(1)) * np.uint64(0x94D049BB133111EB))) * ODD
        y = (y ^ (y >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        run = np.concatenate([[np.uint64(0)], np.cumsum(y, dtype=np.uint64)])
        at = np.cumsum(end - first)
        s = run[at] - run[at - (end - first)]
    return text[found], h[found].view(np.int64), s.view(np.int64), first, end


def text_bits(streams: DataFrame, code: Broadcast, counts: Broadcast) -> DataFrame:
    """``(rid, w, bits, parts)``: the bits of each text's symbols, and its
    segments ``(anchor, segment, bits)``."""
    def coded(m: Mixer, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for rows, ids, place, size in texts(b):
            bits = m.code_texts(ids, place, np.repeat(np.array(rows.column("w").to_pylist(), dtype=np.float32), size))
            text, anchor, segment, first, end = segments(ids, place, size)
            run_bits = np.concatenate([[0.0], np.cumsum(bits)])
            cut = np.concatenate([[0], np.cumsum(size)])
            part = pa.StructArray.from_arrays([pa.array(anchor), pa.array(segment), pa.array(run_bits[end] - run_bits[first])],
                                              names=["anchor", "segment", "bits"])
            offsets = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(size)))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [rows.column("rid"), rows.column("w"), pa.array(run_bits[cut[1:]] - run_bits[cut[:-1]]),
                 pa.ListArray.from_arrays(pa.array(offsets), part)], names=["rid", "w", "bits", "parts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, shard, m = unpacked(counts), None, None
        for b in batches:
            of = np.array(b.column("shard").to_pylist(), dtype=np.int64)
            cut = np.flatnonzero(of[1:] != of[:-1]) + 1
            for i, j in zip([0, *cut], [*cut, len(of)]):
                if i < j:
                    if of[i] != shard:
                        shard, m = of[i], Mixer(code.value, tables)
                    yield from coded(m, b.slice(i, j - i))
    return streams.select("rid", "w", "shard", "ids").mapInArrow(
        run, "rid long, w boolean, bits double, parts array<struct<anchor: long, segment: long, bits: double>>")


def saved_bits(scored: DataFrame) -> DataFrame:
    """``(rid, saved)``: what each segment behind a known anchor costs less
    (or more) than by its symbols."""
    parts = scored.select("rid", "w", F.explode("parts").alias("p")).select(
        "rid", "w", "p.anchor", "p.segment", "p.bits")
    both = materialise(parts.where("w").groupBy("anchor", "segment").agg(F.count("*").alias("n")), "lm-segments")
    known = both.groupBy("anchor").agg(F.sum("n").alias("n_anchor"))
    own = F.col("w").cast("long")
    seen = (parts.join(known, "anchor").join(both, ["anchor", "segment"], "left")
            .withColumn("n_anchor", F.col("n_anchor") - own)
            .withColumn("n", F.greatest(F.coalesce("n", F.lit(0)) - own, F.lit(0))).where("n_anchor > 0"))
    seen = materialise(seen.select("rid", "w", "bits", "n", "n_anchor",
                                   F.least(F.floor(F.log2("n_anchor")), F.lit(7)).cast("int").alias("step")), "lm-passages")
    rates = {r["step"]: r["q"] for r in seen.where("w").groupBy("step").agg(
        ((F.sum((F.col("n") > 0).cast("long")) + 1) / (F.count("*") + 2)).alias("q")).collect()}    # 8 steps at most
    q = F.get(F.array(*[F.lit(float(rates.get(i, 0.5))) for i in range(8)]), F.col("step"))
    p = q * F.col("n") / F.col("n_anchor") + (1 - q) * F.pow(F.lit(2.0), -F.col("bits"))
    # a segment that was not seen costs its own bits and the word that it was not
    return seen.select("rid", F.when(F.col("n") > 0, F.col("bits") + F.log2(p)).otherwise(F.log2(1 - q)).alias("saved"))


def rest_terms(streams: DataFrame) -> DataFrame:
    """``(term, rid, tf)`` for each text's distinct words outside the head."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            term, rid, tf = [], [], []
            for r, x in zip(b.column("rid").to_pylist(), b.column("rest").to_pylist()):
                raw = zlib.decompress(x)
                if raw:
                    n = Counter(raw.split(b" "))
                    term += n
                    rid += [r] * len(n)
                    tf += n.values()
            yield pa.RecordBatch.from_arrays([pa.array(term, pa.binary()), pa.array(rid, pa.int64()), pa.array(tf, pa.int64())],
                                             names=["term", "rid", "tf"])
    return streams.select("rid", "rest").mapInArrow(run, "term binary, rid long, tf long")


def spelling_bits(rare: DataFrame, n_distinct: int) -> DataFrame:
    """``(term, n, bits)`` for the words outside the head."""
    spark = rare.sparkSession
    shards = min(max(1, n_distinct >> 17), 1 << 14)
    train = rare.where("n > 0").select("term", "n").repartition(shards, "term").sortWithinPartitions("term")
    tables = spark.sparkContext.broadcast(spelling.packed(spelling.bit_counts(train)))
    return spelling.word_bits(rare, tables, spelling.fit_weights(train, tables))


def lm_score(docs: DataFrame, folds: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score, n_bytes, bits_per_byte)`` for every row; rows whose crc32
    remainder by ``folds`` is 0 are held out from learning."""
    sc = docs.sparkSession.sparkContext
    d = docs.select((remainder(id_col, folds) != 0).alias("w"), F.col(id_col).alias("doc_id"),
                    F.col(text_col).cast("binary").alias("t"))
    words = materialise(term_counts(d, words_of), "lm-words")
    total = words.agg(F.sum("n").alias("n"), F.sum((F.col("n") > 0).cast("long")).alias("v")).first()
    n_all, n_distinct = int(total["n"] or 0), int(total["v"] or 0)
    below = n_all + 0.1 * (n_distinct + 1)
    least = max(2, -(-n_all // HEAD))
    rows = sorted((-r["n"], bytes(r["term"])) for r in words.where(F.col("n") >= least).collect())  # at most HEAD rows
    often = [-n for n, _ in rows]
    head = sc.broadcast(([x for _, x in rows], np.log10((np.array(often, dtype=np.float64) + 0.1) / below)))
    code = sc.broadcast(Code(often + [n_all - sum(often) + 1]))
    shards = min(max(1, -(-n_all // SHARD)), 1 << 16)
    streams = materialise(encode(d, head, shards), "lm-streams")
    bits = min(max(14, (8 * n_all).bit_length()), MOST_BITS)
    counts = sc.broadcast([zlib.compress(c.tobytes(), 1) for c in bit_counts(streams.where("w"), code, bits, max(sc.defaultParallelism, shards // 8))])
    scored = materialise(text_bits(streams, code, counts), "lm-bits")

    costs = materialise(spelling_bits(words.where(F.col("n") < least), n_distinct), "lm-spelling")
    base = F.log10((F.col("n") + F.lit(0.1)) / F.lit(below))
    zero = F.lit(0.0)
    rest = rest_terms(streams).join(costs, "term").select(
        "rid", (F.col("tf") * (F.col("n") > 0).cast("double")).alias("known"), (F.col("tf") * base).alias("base"),
        (F.col("tf") * F.col("bits")).alias("bits"))
    parts = (rest.unionByName(scored.select("rid", zero.alias("known"), zero.alias("base"), "bits"))
             .unionByName(saved_bits(scored).select("rid", zero.alias("known"), zero.alias("base"), (-F.col("saved")).alias("bits"))))
    sums = parts.groupBy("rid").agg(*[F.sum(c).alias(f"sum_{c}") for c in ("known", "base", "bits")])
    bits_all = F.col("sum_bits")
    return (streams.select("rid", "doc_id", "n_bytes", "n_tokens", "known", "base").join(sums, "rid").select(
        "doc_id", (remainder("doc_id", folds) == 0).alias("held_out"), "n_tokens",
        F.round(F.col("known") + F.col("sum_known")).cast("long").alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"), (F.col("base") + F.col("sum_base")).alias("base_score"),
        (-bits_all * F.lit(math.log10(2))).alias("score"), "n_bytes",
        (bits_all / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte")))
