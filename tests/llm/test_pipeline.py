"""The corpus pipeline, stage by stage, against plain Python."""

from __future__ import annotations

import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from riskframe.llm.base import materialise
from tests.llm.test_operators import slow_fingerprint, smallest, spans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(materialise(stage(spark, out[-1], SF), "test-stage"))
    return out


def test_columns_pass_through(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_columns_of_clashing_names_keep_their_values(spark, stages):
    """Whatever operators call their own columns."""
    names = ["blob", "findings", "copy", "shuffle_key", "n_words", "kept", "llr", "fingerprint", "component_id", "key", "comp",
             "id", "sha", "stays", "_moved", "_hit", "_sha", "_bits", "_text", "_key", "size", "rate", "rid", "t", "_own1"]
    docs = stages[0].limit(60)
    mine = docs.select("*", *[F.concat(F.lit(n), "doc_id").alias(n) for n in names])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        mine = materialise(stage(spark, mine, SF), "test-clash")
        rows = mine.collect()
        assert mine.columns == [*docs.columns, *names] and rows
        assert all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names)
    assert corpus_pipeline.packing_stage(spark, mine, SF).count() >= len(rows)


def test_dedup_keeps_one_of_each_group(stages):
    rows = {r.doc_id: r.text or "" for r in stages[1].collect()}
    fps = {i: slow_fingerprint(t) for i, t in rows.items()}
    comp = smallest(list(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted(set(comp.values()))


def test_dedup_keeps_rows_without_and_with_repeated_ids(spark, stages):
    words = [f"{c}{i} " for c in "abcdef" for i in range(60)]
    texts = {k: "".join(words[60 * k:60 * k + 60]) for k in range(6)}
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (7, texts[3]),
            (8, texts[3]), (None, texts[4]), (9, texts[4]), (3, texts[5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.near_dedup_stage(spark, docs, SF)
    assert collections.Counter(map(tuple, kept.collect())) == collections.Counter(
        [(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (9, texts[4]), (3, texts[5])])


def test_secrets_are_gone_and_nothing_else_changes(stages):
    before = {r.doc_id: r.text for r in stages[2].collect()}
    after = {r.doc_id: r.text for r in stages[3].collect()}
    assert before.keys() == after.keys()
    for i, t in before.items():
        out, at = "", 0
        for start, _, _, end in spans(t or ""):
            if start >= at:
                out += t[at:start] + "[SECRET]"
            at = max(at, end)
        assert after[i] == (out + t[at:] if at else t)


def test_mixing_only_copies(stages):
    assert {tuple(r) for r in stages[4].collect()} <= {tuple(r) for r in stages[3].collect()}


def test_packing_covers_every_copy(stages):
    copies = collections.Counter(r.doc_id for r in stages[4].collect())
    tokens, total = {}, collections.Counter()
    for r in stages[5].collect():
        tokens[r.doc_id] = r.doc_tokens
        total[r.doc_id] += r.length
    assert total == {i: tokens[i] * n for i, n in copies.items()}


def test_run_equals_the_stages_and_empty_input(spark, stages):
    key = lambda df: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert key(corpus_pipeline.run(spark, SF)) == key(stages[5])
    docs = stages[0].limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF), "test-empty")
    assert docs.count() == 0
