"""Spans of text: matches of regular expressions as arrays of structs, with UTF-8 byte positions.

Everything is column expressions: no exchange, no Python. A text's matches come from regexp_extract_all, and their positions
from the lengths of the pieces between them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.dialect import to_java
from palimpsest.sources.patterns import Pattern

SPAN = "struct<type:string,severity:string,pattern:string,matched:string,position:int,end:int>"
SPANS = f"array<{SPAN}>"
NO_SPANS_SQL = f"cast(array() AS {SPANS.replace('end:', '`end`:')})"


def no_spans() -> Column:
    return F.array().cast(SPANS)


def span(type_: Column | str, severity: Column | str, pattern: Column | str, matched: Column, position: Column, end: Column) -> Column:
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(
        as_column(type_).alias("type"), as_column(severity).alias("severity"), as_column(pattern).alias("pattern"),
        matched.alias("matched"), position.cast("int").alias("position"), end.cast("int").alias("end"),
    )


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def placed_matches(text: Column, java: str, groups: int = 0, size: Callable[[Column], Column] = F.octet_length) -> Column:
    """array<struct<matched, position, end, g1 ...>> of all non-empty matches. size: what positions count (bytes here).

    The text is read for matches and for the gaps between them; groups are taken from each match by itself, so an expression with
    groups must match what it has matched once more without the text around it.
    """
    inner = [(f"g{k + 1}", k + 1) for k in range(groups)]
    matched = F.regexp_extract_all(text, F.lit(java), F.lit(0))
    # Where nothing matches there are no gaps to look for.
    found = lambda m: F.struct(m.alias("m"), F.when(F.size(m) > 0, F.split(text, java, -1)).otherwise(F.array().cast("array<string>")).alias("gap"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("ends"))

    def ends(x: Column) -> Column:
        step = lambda s, r: let(s["at"] + size(r["gap"]) + size(r["m"]), lambda e: F.struct(e.cast("int").alias("at"), F.concat(s["ends"], F.array(e.cast("int"))).alias("ends")))
        return F.aggregate(F.arrays_zip(x["m"].alias("m"), F.slice(x["gap"], F.lit(1), F.size(x["m"])).alias("gap")), start, step, lambda s: s["ends"])

    def placed(x: Column) -> Column:
        rows = F.arrays_zip(x["m"].alias("m"), ends(x).alias("e"))
        return F.transform(rows, lambda r: F.struct(r["m"].alias("matched"), (r["e"] - size(r["m"])).cast("int").alias("position"), r["e"].alias("end"), *[F.regexp_extract(r["m"], java, k).alias(g) for g, k in inner]))

    return let(matched, lambda m: let(found(m), placed))


def pattern_spans(text: Column, pattern: Pattern, gate: Column | None = None) -> Column:
    """Spans of one pattern. gate: a cheap condition that every text with a match meets."""
    java = pattern.java
    hit = text.rlike(java) if gate is None else gate & text.rlike(java)
    found = F.transform(
        F.filter(placed_matches(text, java), lambda x: x["end"] > x["position"]),
        lambda x: span(pattern.type, pattern.severity, pattern.name, x["matched"], x["position"], x["end"]),
    )
    return F.when(hit, found).otherwise(no_spans())


def quoted(value: str) -> str:
    """A string literal of SQL."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def pattern_sql(text: str, pattern: Pattern, gate: str = "true") -> str:
    """pattern_spans as SQL. text and gate: SQL. A plan of many patterns is built much faster from text than call by call."""
    rx = quoted(pattern.java)
    ends = (
        "aggregate(sequence(0, size(f.m) - 1), named_struct('at', 0, 'ends', cast(array() AS array<int>)), (s, i) -> "
        "get(transform(array(s.at + octet_length(f.gap[i]) + octet_length(f.m[i])), e -> named_struct('at', e, 'ends', concat(s.ends, array(e)))), 0), s -> s.ends)"
    )
    named = f"'type', {quoted(pattern.type)}, 'severity', {quoted(pattern.severity)}, 'pattern', {quoted(pattern.name)}"
    rows = f"get(transform(array({ends}), e -> transform(f.m, (m, i) -> named_struct({named}, 'matched', m, 'position', e[i] - octet_length(m), 'end', e[i]))), 0)"
    found = f"get(transform(array(named_struct('m', regexp_extract_all({text}, {rx}, 0), 'gap', split({text}, {rx}, -1))), f -> filter({rows}, x -> x.end > x.position)), 0)"
    return f"if({gate} AND {text} RLIKE {rx}, {found}, {NO_SPANS_SQL})"


def regex_matches(text: Column, regex: str, groups: int = 0) -> Column:
    """placed_matches of an expression in RE2's dialect."""
    return placed_matches(text, to_java(regex), groups)
