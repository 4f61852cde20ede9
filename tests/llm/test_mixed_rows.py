"""The mix as documents on ids that repeat over sources, rows without an id, and equal rows."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from palimpsest.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words_by_source(docs):
    mixed = Counter()
    for r in mixing.mixed_documents(docs).collect():
        mixed[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    taken = mixing.taken_words(docs)
    # Sources by their own words: every word names its source.
    return mixed, taken


def test_ids_that_repeat_over_sources(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(f"{s}{rng.randrange(9999)}" for _ in range(300)), "en", s, 1) for s in "abc" for i in range(30)]
    docs = spark.createDataFrame(rows, SCHEMA)
    mixed, taken = words_by_source(docs)
    sizes = {r.t: r.n for r in taken.groupBy("target").agg(F.sum("taken").alias("n")).select(F.col("target").alias("t"), "n").collect()}
    assert sorted(mixed.values()) == sorted(sizes.values())
    for r in mixing.mixed_documents(docs).collect():
        assert all(w.startswith(r.source) for w in r.text.split())


def test_rows_without_id_and_equal_rows(spark):
    rows = [(None, f"{s} same words in every one of these rows " * 9 + (str(k) if k % 3 else ""), "en", s, 1) for s in ("a", "b", None) for k in range(12)]
    rows += [(7, "twice the same text " * 20, lang, "a", 1) for lang in ("en", "en", "de")] + [(7, "twice the same text " * 20, "en", "b", 1), (8, None, "en", "a", 1), (9, " \n", "en", "b", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    mixed, taken = words_by_source(docs)
    assert sum(mixed.values()) == taken.agg(F.sum("taken")).first()[0]
    assert sorted(mixed.values()) == sorted(r.n for r in taken.groupBy("target").agg(F.sum("taken").alias("n")).collect() if r.n)
    langs = Counter(r.lang for r in mixing.mixed_documents(docs.where("doc_id = 7 AND source = 'a'")).collect())
    assert set(langs) == {"en", "de"}
