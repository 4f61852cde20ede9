import pytest

from palimpsest.functions.dialect import Unsupported, to_java
from palimpsest.sources import patterns


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return path


GOOD = "patterns:\n  - {name: emp, regex: 'EMP-[0-9]+', type: pii, severity: BLOCK}\n"


def test_defaults():
    found = patterns.load()
    assert len(found) == 24 and found[0].name == "openai_api_key" and found[-1].name == "postal_code"
    assert next(p for p in found if p.name == "password_var").regex == r"""(password|passwd|pwd)\s*[:=]\s*['"]?[^\s'"]{8,}['"]?"""


def test_first_definition_wins_and_bad_files_are_left_out(tmp_path, caplog):
    write(tmp_path / "a.yaml", GOOD)
    write(tmp_path / "b.YML", "patterns:\n  - {name: emp, regex: 'other', type: pii, severity: LOG}\n  - {name: email, regex: 'x', type: pii, severity: LOG}\n")
    write(tmp_path / "c.yaml", "patterns:\n  - {name: x, regex: '', type: pii, severity: LOG}\n")
    write(tmp_path / "d.yaml", "patterns: [\n")
    write(tmp_path / "e.txt", "nothing")
    write(tmp_path / "f.yaml", "patterns:\n  - {name: broken, regex: '(', type: pii, severity: LOG}\n")
    found = {p.name: p.regex for p in patterns.load(custom=tmp_path)}
    assert found["emp"] == "EMP-[0-9]+" and found["email"] != "x" and "broken" not in found and len(found) == 25


@pytest.mark.parametrize("change", [{"name": ""}, {"regex": None}, {"type": "secret"}, {"severity": "block"}, {"severity": " "}])
def test_checks(change):
    good = {"name": "a", "regex": "b", "type": "pii", "severity": "LOG"}
    assert patterns.check(good).description == ""
    with pytest.raises(patterns.PatternError):
        patterns.check(good | change)


def test_missing_and_empty(tmp_path):
    with pytest.raises(patterns.PatternError):
        patterns.read_directory(tmp_path / "none")
    with pytest.raises(patterns.PatternError):
        patterns.load(default=tmp_path)
    assert [p.name for p in patterns.read_directory(write(tmp_path / "one.yaml", GOOD))] == ["emp"]


@pytest.mark.parametrize(
    ("regex", "text", "hits"),
    [
        (r"\b[0-9]{3}\b", "é123 _123 123", ["123", "123"]), (r"a\sb", "a\x0bb a b", ["a b"]), (r"(?i)k[a-z]y", "Key KEY Key", ["Key", "KEY", "Key"]),
        (r"^ab$", "ab\n", []), (r"a.b", "a\rb a\nb", ["a\rb"]), (r"(?i)[a-z0-9_. -]+!", "a-b c!", ["a-b c!"]), (r"[]a]+", "a]", ["a]"]), (r"(?i)[-s]+", "-sSſ", ["-sSſ"]),
    ],
)
def test_dialect(spark, regex, text, hits):
    from pyspark.sql import functions as F

    assert spark.createDataFrame([(text,)], "t string").select(F.regexp_extract_all("t", F.lit(to_java(regex)), F.lit(0)).alias("m")).first().m == hits


def test_unsupported():
    with pytest.raises(Unsupported):
        to_java(r"\C")
