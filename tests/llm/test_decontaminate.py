"""Decontamination against a brute-force scan of all windows."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.llm import decontaminate as dc

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def _lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def _brute(docs, items, size):
    windows = {}
    for item, t in items:
        w = WORD.findall(_lower(t))
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[i:i + size]), set()).update([str(item)] if item is not None else [])
    out = []
    for doc, t in docs:
        at = [(m.start(), m.end()) for m in WORD.finditer(_lower(t))]
        w = [_lower(t)[a:b] for a, b in at]
        hit, ids = set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                k = tuple(w[i:i + n])
                if k in windows:
                    hit |= set(range(i, i + n))
                    ids |= windows[k]
        out.append((doc, len(w), [at[i] for i in sorted(hit)], sorted(ids, key=str.encode)))
    return out


def _key(row):
    return row[0] is None, row[0] or 0, row[1], str(row[2])


def _made(rng, n):
    vocab = ["Ab", "ab", "x1", "é", "É", "日本", "z\x85z", "a b", "Q", "7"]
    sep = [" ", "-", "\n", ".", "_", "\x00", "~ "]
    return "".join(vocab[rng.integers(0, len(vocab))] + sep[rng.integers(0, len(sep))] for _ in range(n))


@pytest.mark.parametrize("step, part", [(2 << 20, 64 << 20), (64, 64 << 20), (7, 3000)])
def test_matches_brute_force(spark, monkeypatch, step, part):
    """Also when texts are worked on in small steps and the benchmark comes
    in many parts."""
    monkeypatch.setattr(dc, "STEP", step)
    monkeypatch.setattr(dc, "PART", part)
    rng = np.random.default_rng(2)
    items = [(i, _made(rng, int(rng.integers(1, 9)))) for i in range(30)] + [(3, _made(rng, 3)), (None, "ab"), (99, None), (98, " .-")]
    docs = [(i, _made(rng, int(rng.integers(0, 60)))) for i in range(60)]
    docs += [(100, items[4][1] + items[5][1]), (101, None), (102, ""), (103, "..."), (100, items[4][1] + items[5][1]), (None, "é ab")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("hits", F.lit("mine")).repartition(3)
    it = spark.createDataFrame(items, "item_id long, text string")
    got = [(r.doc_id, r.n_words, [tuple(h) for h in r.hits], r["items"])
           for r in dc.find_contamination(df, it, size=4).collect()]
    assert sorted(got, key=_key) == sorted(_brute(docs, items, 4), key=_key)


def test_collisions_are_compared_by_words(spark, monkeypatch):
    monkeypatch.setattr(dc, "word_hashes", lambda data, starts, ends: np.ones(len(starts), dtype=np.uint64))
    w = dc.Windows({(b"a", b"b"): ["1"], (b"c", b"d"): ["2"]})
    import pyarrow as pa
    n, found = dc._scan(pa.array(["a b c", "x y", "C d"], pa.large_string()), w)
    assert n.tolist() == [3, 2, 2] and found == {0: ([(0, 1), (2, 3)], {"1"}), 2: ([(0, 1), (2, 3)], {"2"})}


def test_removal_and_other_columns(spark):
    docs = spark.createDataFrame([(1, "Un, deux trois QUATRE; é.", "k"), (2, "rien", "l"), (3, None, "m")], "doc_id int, text string, items string")
    items = spark.createDataFrame([(7, "DEUX trois quatre")], "item_id int, text string")
    found = dc.find_contamination(docs, items, size=3).cache()
    assert [r.text for r in dc.remove_spans(found).orderBy("doc_id").collect()] == ["Un,   ; é.", "rien", None]
    assert [r.doc_id for r in dc.remove_documents(found).orderBy("doc_id").collect()] == [2, 3]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id int, text string")
    none = spark.createDataFrame([], "item_id int, text string")
    r = dc.find_contamination(docs, none).first()
    assert (r.n_words, r.hits, r["items"]) == (2, [], [])
    assert dc.find_contamination(docs.limit(0), docs.withColumnRenamed("doc_id", "item_id")).count() == 0


def test_very_long_text(spark):
    text = "Ab cd " * 400_000 + "one two three"
    docs = spark.createDataFrame([(1, text), (2, "one two three")], "doc_id int, text string")
    items = spark.createDataFrame([(5, "one two three")], "item_id int, text string")
    got = dc.find_contamination(docs, items).select("doc_id", "n_words", F.size("hits"), dc.item_digest(F.col("items"))).collect()
    digest = hashlib.sha256(b"5").hexdigest()
    assert sorted(map(tuple, got)) == [(1, 800_003, 3, digest), (2, 3, 3, digest)]
