"""Detection over a text column: all detectors, their union, and the spans that stay."""

from __future__ import annotations

import functools
import re

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.sources.patterns import Pattern, load

from .advanced import advanced_spans
from .overlap import resolved
from .secrets import secret_spans
from .spans import NO_SPANS_SQL, no_spans, pattern_spans, pattern_sql, quoted

#: Default patterns by what every text with a match of theirs holds: a part of the text, or an expression that is quick to
#: look for. One test spares most texts the whole group.
PARTS = {
    "openai_api_key": "sk-", "anthropic_api_key": "sk-ant-", "google_api_key": "AIza", "postgres_connection": "postgres://",
    "mongodb_connection": "mongodb", "mysql_connection": "mysql://", "jwt_token": "eyJ", "ssh_private_key": "-----BEGIN",
}
LONG_NUMBER = r"[0-9][0-9\s().-]{6,}[0-9]"
FORMS = {
    LONG_NUMBER: ("nigerian_bvn", "nigerian_phone", "nigerian_account", "kenyan_phone", "mpesa_code", "south_african_id", "south_african_phone", "ghanaian_phone", "credit_card"),
    "AKIA|ASIA": ("aws_access_key",),
    "@": ("email",),
    "[A-Z]{2}[0-9]{2}[A-Z0-9]": ("iban",),
    "[A-Z]{6}[A-Z0-9]{2}": ("swift_code",),
    "passw|pwd": ("password_var",),
    "[0-9][-/.][0-9]": ("date_of_birth",),
    "(?i)zip|post": ("postal_code",),
}


_TEXT, _SPANS = "_palimpsest_text", "_palimpsest_spans"


def raw_spans(text: Column, patterns: list[Pattern] | None = None, contextual: Column | None = None, sql: str | None = None) -> Column:
    """Spans of all detectors in one array, overlapping or not. contextual: further spans, such as a model's.

    sql: the text as SQL, where it has a name; patterns are then one expression in SQL, which is built in a fraction of the time.
    """
    patterns = load() if patterns is None else patterns
    loaded = {p.name: p for p in patterns}
    found = [secret_spans(text), advanced_spans(text, loaded)]
    if sql is not None:
        found += [pattern_group(sql, patterns)] if patterns else []
    else:
        by_part, by_form, others = _grouped(patterns)
        found += [pattern_spans(text, p, F.contains(text, F.lit(part))) for part, p in by_part]
        for form, group in by_form:
            found.append(F.when(text.rlike(form), F.concat(*[pattern_spans(text, p) for p in group])).otherwise(no_spans()))
        found += [pattern_spans(text, p) for p in others]
    return F.concat(*found, *([contextual] if contextual is not None else []))


def _grouped(patterns: list[Pattern]) -> tuple[list[tuple[str, Pattern]], list[tuple[str, list[Pattern]]], list[Pattern]]:
    """Default patterns with the part of theirs, groups of them with their form, and all others."""
    loaded = {p.name: p for p in patterns}
    shipped = {p.name: p.regex for p in load()}
    default = {n: p for n, p in loaded.items() if shipped.get(n) == p.regex}
    by_part = [(part, default[n]) for n, part in PARTS.items() if n in default]
    by_form = [(form, [default[n] for n in names if n in default]) for form, names in FORMS.items()]
    grouped = {n for names in FORMS.values() for n in names} | set(PARTS)
    return by_part, [(form, group) for form, group in by_form if group], [p for n, p in loaded.items() if n not in default or n not in grouped]


def pattern_group(sql: str, patterns: list[Pattern]) -> Column:
    """Spans of all patterns over a text that has a name in SQL. A text without a form's like is spared the form's whole group."""
    by_part, by_form, others = _grouped(patterns)
    # Plain words need no expression.
    held = lambda form: " OR ".join(f"contains({sql}, {quoted(w)})" for w in form.split("|")) if re.fullmatch(r"[\w@|]+", form) else f"{sql} RLIKE {quoted(form)}"
    parts = [pattern_sql(sql, p, f"contains({sql}, {quoted(part)})") for part, p in by_part]
    parts += [f"if({held(form)}, concat({', '.join(pattern_sql(sql, p) for p in group)}), {NO_SPANS_SQL})" for form, group in by_form]
    parts += [pattern_sql(sql, p) for p in others]
    return F.expr(f"concat({', '.join(parts)})")


def detect(df: DataFrame, text: str = "text", patterns: list[Pattern] | None = None, out: str = "violations", contextual: str | None = None) -> DataFrame:
    """df with the spans that stay, by position; a null text has none. Narrow projections only."""
    # The patterns are SQL over a fixed name, so a column may have any name.
    rest = [F.col(f"`{c}`") for c in df.columns if c != out]
    named = df.select(*rest, F.coalesce(F.col(text), F.lit("")).alias(_TEXT), *([F.col(contextual).alias(_SPANS)] if contextual else []))
    found = named.select(*rest, _every_span(tuple(load() if patterns is None else patterns), bool(contextual), df.sparkSession.sparkContext).alias(out))
    return found.select(*rest, resolved(F.col(f"`{out}`")).alias(out))


@functools.lru_cache(maxsize=16)
def _every_span(patterns: tuple[Pattern, ...], contextual: bool, context: SparkContext) -> Column:
    """raw_spans over the fixed names. It takes thousands of calls to build, so it is built once for each context."""
    return raw_spans(F.col(_TEXT), list(patterns), F.col(_SPANS) if contextual else None, _TEXT)


def one_by_one(df: DataFrame, array: str, *columns: str) -> DataFrame:
    """A row ``x`` for each element of an array column, behind the named columns.

    The outer form keeps the planner from filtering by the array's size first, which would compute the array twice.
    """
    return df.select(*columns, F.explode_outer(array).alias("x")).where(F.col("x").isNotNull())


def exploded(df: DataFrame, violations: str = "violations") -> DataFrame:
    """A row for each span, its fields as columns behind df's other columns."""
    rest = [c for c in df.columns if c != violations]
    return one_by_one(df, violations, *rest).select(*rest, "x.*")
