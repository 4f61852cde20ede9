"""The corpus pipeline against plain versions of its stages, and the registered queries."""

from collections import Counter

import pytest

pytest.importorskip("corpus_pipeline")

import corpus_pipeline
from palimpsest.llm import mixing, sentencepiece_scan
from palimpsest.llm import queries as llm

from test_near_duplicates import plain_kept

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage gets and returns, in order."""
    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.written(stage(spark, docs, SF), "test")
        seen.append((name, docs, out))
        docs = out
    return seen


def test_columns_and_effects(stages):
    for name, before, after in stages[:-1]:
        assert after.columns == before.columns, name
    assert stages[0][2].count() < stages[0][1].count()


def test_near_duplicates_keep_the_least_of_each_group(stages):
    _, before, after = stages[2]
    rows = before.select("doc_id", "text").collect()
    want, got = set(plain_kept([(r.doc_id, r.text) for r in rows])), {r.doc_id for r in after.select("doc_id").collect()}
    assert want <= got and len(got - want) <= 1


def test_mix_holds_the_words_taken(stages):
    _, before, after = stages[3]
    want = {r.doc_id: r.taken for r in mixing.taken_words(before).collect() if r.taken}
    got = Counter()
    for r in after.select("doc_id", "text").collect():
        got[r.doc_id] += len((r.text or "").encode().split())
    assert got == want


def test_encoding_round_trips(stages):
    _, before, after = stages[4]
    p = sentencepiece_scan.pieces(sentencepiece_scan.MODEL)
    assert after.count() == before.count()
    for r in after.collect():
        assert list(r.piece_ids) == p.encode(r.text or "") and p.library.decode(list(r.piece_ids)) == r.text and r.n_pieces == len(r.piece_ids)


def test_run_equals_the_stages(spark, stages):
    key = lambda df: Counter((r.doc_id, r.text, tuple(r.piece_ids)) for r in df.collect())
    assert key(corpus_pipeline.run(spark, SF)) == key(stages[-1][2])


def test_every_operator_is_registered():
    names = list(llm.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert set(llm.oracle_sql()) <= set(names)
