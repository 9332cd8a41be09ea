"""Corpus term counts and per-document term sums.

Both are used where a document's result is a sum, over its terms, of a
number that is known once per distinct term.  Terms that make up at least
1 / ``HEAD`` of all occurrences (by counting, at most ``HEAD`` terms) are
looked up in a broadcast dictionary; all others meet their numbers in a
shuffle join.  So no very common term travels, the dictionary has a proven
bound, and nothing is dropped.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAD = 1 << 18
FLUSH = 400_000     # distinct terms that a task counts before it passes them on
KEPT = 1 << 18      # values whose parts a task remembers
ROWS = 200_000      # rows of a batch that a task passes on
DOCS = 64           # texts whose new values are cut into terms together


def itself(terms: list[bytes]) -> list[tuple[bytes, ...]]:
    return [(x,) for x in terms]


def term_counts(docs: DataFrame, terms_of: Callable[[bytes], list],
                parts_of: Callable[[list[bytes]], list[tuple[bytes, ...]]] = itself) -> DataFrame:
    """``(term binary, n long)`` over ``docs(w, t)``: ``n`` counts rows with
    ``w``; terms of the other rows only are there with 0.  ``parts_of`` cuts
    what ``terms_of`` gives into terms, many distinct values at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())

        def out(w: int) -> pa.RecordBatch:
            c = counts[w]
            if parts_of is not itself:
                c = {}
                for cut, n in zip(parts_of(list(counts[w])), counts[w].values()):
                    for y in cut:
                        c[y] = c.get(y, 0) + n
            b = pa.RecordBatch.from_arrays([
                pa.array(list(c), pa.binary()),
                pa.array(list(c.values()) if w else [0] * len(c), pa.int64())], names=["term", "n"])
            counts[w].clear()
            return b
        for b in batches:
            for w, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                c = counts[bool(w)]
                c.update(terms_of(t or b""))
                if len(c) > FLUSH:
                    yield out(bool(w))
        for w in (0, 1):
            if counts[w]:
                yield out(w)
    return docs.select("w", "t").mapInArrow(run, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n"))


def head_terms(table: DataFrame, values: list[str]) -> dict:
    """The terms of ``table(term, n, ...)`` with at least 1 / HEAD of all
    counts, as a dictionary of their ``values``."""
    total = table.agg(F.sum("n")).first()[0] or 0
    least = max(1, -(-total // HEAD))
    rows = table.where(F.col("n") >= least).select("term", *values).collect()   # at most HEAD rows
    return {bytes(r[0]): tuple(r[1:]) for r in rows}


def document_terms(docs: DataFrame, terms_of: Callable[[bytes], list], head: dict, n_values: int,
                   parts_of: Callable[[list[bytes]], list[tuple[bytes, ...]]] = itself) -> DataFrame:
    """``docs(doc_id, t)`` as rows ``(term, rid, tf, doc_id, n_bytes, n_terms, s0, s1, ...)``.

    Every document gives one row with its id, sizes and its sums over head
    terms, under a term that no text has, and one row for each other
    distinct term with its frequency.  ``rid`` names the input row, so rows
    without an id or with the same id stay apart."""
    shared = docs.sparkSession.sparkContext.broadcast(head)
    kind = docs.schema["doc_id"].dataType
    sums = [f"s{i}" for i in range(n_values)]
    schema = f"term binary, rid long, tf long, doc_id {kind.simpleString()}, n_bytes long, n_terms long, " + \
        ", ".join(f"{s} double" for s in sums)
    d = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, zero, seen = shared.value, (0.0,) * n_values, {}

        def look_up(values: list[bytes]) -> dict[bytes, tuple]:
            """The sums over the head terms among each value's parts, and its other parts."""
            found = {}
            for x, cut in zip(values, parts_of(values)):
                if len(cut) == 1:
                    y, = cut
                    found[x] = (tuple(known[y]), ()) if y in known else (zero, cut)
                    continue
                head_parts, rest = [], []
                for y in cut:
                    (head_parts if y in known else rest).append(y)
                found[x] = (tuple(map(sum, zip(*(known[y] for y in head_parts)))) or zero, rest)
            if len(seen) < KEPT:
                seen.update(found)
            return found

        def counted(b: pa.RecordBatch) -> Iterator[tuple]:
            """Rows with their values' counts, and what is to be known of new values."""
            for at in range(0, b.num_rows, DOCS):
                part = b.slice(at, DOCS)
                texts = [t or b"" for t in part.column(2).to_pylist()]
                tfs = [Counter(terms_of(t)) for t in texts]
                new = look_up(list(set().union(*tfs).difference(seen)))
                yield from ((rid, doc_id, t, tf, new) for rid, doc_id, t, tf in
                            zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts, tfs))

        for b in batches:
            id_type = b.column(1).type
            cols: list[list] = [[] for _ in range(6 + n_values)]

            def out() -> pa.RecordBatch:
                types = [pa.binary(), pa.int64(), pa.int64(), id_type, pa.int64(), pa.int64()] + [pa.float64()] * n_values
                r = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                               names=["term", "rid", "tf", "doc_id", "n_bytes", "n_terms", *sums])
                for c in cols:
                    c.clear()
                return r
            for rid, doc_id, t, tf, new in counted(b):
                rest: dict = {}
                acc = [0.0] * n_values
                for x, n in tf.items():
                    sums_of, others = seen.get(x) or new[x]
                    if sums_of is not zero:
                        for i, v in enumerate(sums_of):
                            acc[i] += n * v
                    for y in others:
                        rest[y] = rest.get(y, 0) + n
                more = len(rest)
                cols[0] += [b"  %d" % rid, *rest]
                cols[1] += [rid] * (more + 1)
                cols[2] += [0, *rest.values()]
                cols[3] += [doc_id, *[None] * more]
                cols[4] += [len(t), *[None] * more]
                cols[5] += [tf.total(), *[None] * more]
                for i in range(n_values):
                    cols[6 + i] += [acc[i], *[None] * more]
                if len(cols[0]) > ROWS:
                    yield out()
            if cols[0]:
                yield out()
    return d.mapInArrow(run, schema)
