"""Gates in front of detectors: they spare work and no match."""

import random
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from palimpsest.functions import dialect
from palimpsest.operators import detect, secrets
from palimpsest.plans import catalogue
from palimpsest.sources.patterns import load


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents of a few rows, one without a text."""
    out = tmp_path_factory.mktemp("gates")
    rows = [(1, "a@b.co", "s", "en"), (2, None, "s", "en"), (3, "nothing here", None, "de"), (4, "api_key = 'Ab3dEf6hIj9kLm2nOp5q' and 4111111111111111", "t", "de")]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(str(out / "documents.parquet"))
    return str(out)


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_type_summary_detects_once(spark, tables):
    mark = "AIza[0-9A-Za-z"
    once = optimized(catalogue.violations(spark, tables)).count(mark)
    assert once and optimized(catalogue.type_summary(spark, tables)).count(mark) == once
    got = {r.id: r.summary for r in catalogue.type_summary(spark, tables).where("id > 0").collect()}
    assert got == {1: "pii:1", 4: "credential:1,financial:1"}


def test_overlap_resolved_looks_for_forms_first(spark, tables):
    plan = optimized(catalogue.overlap_resolved(spark, tables))
    assert plan.count(detect.LONG_NUMBER) >= 1 and "AKIA)" in plan


def test_generic_secrets_are_looked_for_where_a_keyword_is(spark, tables):
    assert "redent)" in optimized(catalogue.queries()["generic_secret"](spark, tables))


def test_keywords_are_those_of_the_gate(spark):
    rng = random.Random(11)
    parts = ["se", "SE", "ſe", "cret", "CRET", "to", "TO", "ken", "Ken", "KEN", "pass", "paſs", "PASſ", "word", "ke", "Ke", "y", "red", "ent", "essi", "eſs", "ion", " ", "é", "İ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 5))) for _ in range(5000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", secrets.has_keyword(F.col("t")).alias("a"), F.col("t").rlike(secrets.KEYWORD_GATE).alias("b"))
    assert not [r.t for r in df.where("b and not a").collect()][:3]
    assert 200 < df.where("a").count() < 4900


@pytest.mark.parametrize("regex", [p.regex for p in load() if p.regex.startswith(r"\b")] + [r"\b[0-9]?x", r"\b\d{0,2}-", r"(?i)\b[a-z]{2}", r"\b[A-z]b", r"\b[+-9]a"])
def test_word_heads_match_what_boundaries_match(spark, regex, monkeypatch):
    rng = random.Random(13)
    signs = ["12", "2024-", "1/2/", "1", "AB", "ABCDEFGH", "x", "_", "[b", "b", "+a", "-", ".", " ", "é", "K", "ſ", "\n", "12345678901", "AKIA" + "A" * 16, "sk-proj-" + "a" * 21]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(1, 12))) for _ in range(2000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = lambda: [r[0] for r in df.select(F.regexp_extract_all("t", F.lit(dialect.to_java(regex)), F.lit(0))).collect()]
    ours = found()
    monkeypatch.setattr(dialect, "_WORD_HEAD", __import__("re").compile(r"(?!)"))
    assert ours == found()


def test_a_word_head_is_looked_for_before_its_boundary():
    assert dialect.to_java(r"\b[0-9]{11}").startswith("(?=[0-9])(?<!")
