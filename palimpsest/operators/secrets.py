"""Secrets that need no pattern file: AWS keys and assignments, and generic key-value secrets."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.checks import bare_value, char_classes, compact_key, entropy

from .spans import let, no_spans, regex_matches, span

MIN_LENGTH = 20
MIN_ENTROPY = 3.5
#: The expressions' parts.
_KEY_ID = r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"
_SEPARATOR = r"""["']?\s*(=|:|\bis\b)\s*"""
_VALUE = r"""("[^"]+"|'[^']+'|[^\s,;]+)"""
_AWS_LONG = "[A-Z0-9_ -]*AWS[A-Z0-9_ -]*SECRET[A-Z0-9_ -]*ACCESS[A-Z0-9_ -]*KEY"
_AWS_SHORT = "awsSecretAccessKey|secret_access_key|SecretAccessKey|AWS_SESSION_TOKEN|aws_session_token|awsSessionToken|session_token|SessionToken"
_KEYWORDS = "client_secret|private_key|api_key|apikey|credential|password|secret|token"
_CLASS = "a-z0-9_. -"
#: Part of every keyword, by its rarest letters, in either case and with the signs that fold to k and s.
KEYWORD_GATE = r"[eE][cC][rR][eE][tT]|[tT][oO][kK\x{212A}][eE][nN]|[pP][aA][sS\x{017F}]{2}[wW]|[eE][sS\x{017F}]{2}[iI][oO][nN]|[kK\x{212A}][eE][yY]|[rR][eE][dD][eE][nN][tT]"
#: Those parts in lower case, and the signs by which a text may hold one in another form.
KEYWORD_PARTS, FOLDED_SIGNS = ("ecret", "token", "passw", "ession", "key", "redent"), ("\u017f", "\u212a")
#: Part of every AWS key.
AWS_GATE = r"(?iu)secret[A-Z0-9_ -]*access|session_?token"
#: A match may start only where a run of key characters starts, after ``export`` or a quote, or where the last match ended:
#: the leftmost match is the same, and long runs of words are read once.
AWS_ASSIGNMENT = rf"""(?i)(?:\bexport\s+["']?({_AWS_LONG}|{_AWS_SHORT})|["']({_AWS_LONG}|{_AWS_SHORT})|(?:(?<![A-Z0-9_ -])|\G)({_AWS_LONG})|({_AWS_SHORT})){_SEPARATOR}{_VALUE}"""
GENERIC_ASSIGNMENT = rf"""(?i)(?:\bexport\s+["']?|["']|(?<![{_CLASS}])|\G)([{_CLASS}]*(?:{_KEYWORDS})[{_CLASS}]*){_SEPARATOR}{_VALUE}"""


def _credential(pattern: Column | str, x: Column) -> Column:
    return span("credential", "BLOCK", pattern, x["matched"], x["position"], x["end"])


def overlaps(a: Column, b: Column) -> Column:
    return (a["position"] < b["end"]) & (b["position"] < a["end"])


def aws_spans(text: Column) -> Column:
    ids = F.transform(regex_matches(text, _KEY_ID), lambda x: _credential("aws_access_key_id", x))
    key = lambda x: compact_key(F.concat(*[F.coalesce(x[f"g{k}"], F.lit("")) for k in range(1, 5)]))
    value = lambda x: bare_value(x["g6"])
    secret = lambda x: key(x).isin("awssecretaccesskey", "secretaccesskey") & value(x).rlike(r"\A[A-Za-z0-9/+=]{40}\z")
    session = lambda x: key(x).isin("awssessiontoken", "sessiontoken") & value(x).rlike(r"\A[A-Za-z0-9/+=]{80,}\z")
    found = F.filter(regex_matches(text, AWS_ASSIGNMENT, 6), lambda x: secret(x) | session(x))
    assigned = F.transform(found, lambda x: _credential(F.when(secret(x), "aws_secret_access_key").otherwise("aws_session_token"), x))
    short = F.contains(text, F.lit("AKIA")) | F.contains(text, F.lit("ASIA"))
    return F.concat(F.when(short, ids).otherwise(no_spans()), F.when(has_keyword(text) & text.rlike(AWS_GATE), assigned).otherwise(no_spans()))


def generic_pattern(key: Column) -> Column:
    compact = compact_key(key)
    return (
        F.when(F.contains(compact, F.lit("privatekey")), "generic_private_key_assignment")
        .when(F.contains(compact, F.lit("apikey")), "generic_api_key_assignment")
        .when(F.contains(compact, F.lit("token")), "generic_token_assignment")
        .otherwise("generic_secret_assignment")
    )


def is_secret_value(value: Column) -> Column:
    return let(value, lambda v: (F.octet_length(v) >= MIN_LENGTH) & (char_classes(v) >= 2) & (entropy(v) >= MIN_ENTROPY))


def has_keyword(text: Column) -> Column:
    """Whether a text holds what KEYWORD_GATE matches; plain parts are looked for first, many times faster than the expression."""
    held = lambda x, parts: functools.reduce(lambda a, b: a | b, [F.contains(x, F.lit(p)) for p in parts])
    return let(F.lower(text), lambda low: held(low, KEYWORD_PARTS)) | (held(text, FOLDED_SIGNS) & text.rlike(KEYWORD_GATE))


def generic_spans(text: Column, taken: Column) -> Column:
    """Key-value secrets that don't overlap the spans in ``taken``; a text without a keyword isn't searched."""
    found = F.filter(regex_matches(text, GENERIC_ASSIGNMENT, 3), lambda x: ~F.exists(taken, lambda t: overlaps(t, x)) & is_secret_value(bare_value(x["g3"])))
    return F.when(has_keyword(text), F.transform(found, lambda x: _credential(generic_pattern(x["g1"]), x))).otherwise(no_spans())


def secret_spans(text: Column) -> Column:
    found = let(aws_spans(text), lambda aws: F.concat(aws, generic_spans(text, aws)))
    return F.when(F.contains(text, F.lit("AKIA")) | F.contains(text, F.lit("ASIA")) | has_keyword(text), found).otherwise(no_spans())
