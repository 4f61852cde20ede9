"""Rewriting texts: labels for spans, counts and the safe flag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.sources.patterns import Pattern

from .detect import detect

#: Labels of patterns, then of types.
LABELS = {
    "openai_api_key": "[REDACTED_API_KEY]", "anthropic_api_key": "[REDACTED_API_KEY]", "google_api_key": "[REDACTED_API_KEY]",
    "aws_access_key": "[REDACTED_AWS_KEY]", "aws_access_key_id": "[REDACTED_AWS_ACCESS_KEY_ID]",
    "aws_secret_access_key": "[REDACTED_AWS_SECRET_ACCESS_KEY]", "aws_session_token": "[REDACTED_AWS_SESSION_TOKEN]",
    "generic_secret_assignment": "[REDACTED_CREDENTIAL]", "generic_token_assignment": "[REDACTED_CREDENTIAL]",
    "generic_api_key_assignment": "[REDACTED_CREDENTIAL]", "generic_private_key_assignment": "[REDACTED_CREDENTIAL]",
    "postgres_connection": "[REDACTED_DB_CONNECTION]", "mongodb_connection": "[REDACTED_DB_CONNECTION]", "mysql_connection": "[REDACTED_DB_CONNECTION]",
    "jwt_token": "[REDACTED_TOKEN]", "email": "[REDACTED_EMAIL]", "nigerian_bvn": "[REDACTED_BVN]",
    "nigerian_phone": "[REDACTED_PHONE]", "kenyan_phone": "[REDACTED_PHONE]", "south_african_phone": "[REDACTED_PHONE]", "ghanaian_phone": "[REDACTED_PHONE]",
    "nigerian_account": "[REDACTED_ACCOUNT]", "mpesa_code": "[REDACTED_MPESA]", "south_african_id": "[REDACTED_ID]", "credit_card": "[REDACTED_CARD]",
    "iban": "[REDACTED_IBAN]", "swift_code": "[REDACTED_SWIFT]", "ssh_private_key": "[REDACTED_PRIVATE_KEY]", "password_var": "[REDACTED_PASSWORD]",
    "date_of_birth": "[REDACTED_DOB]", "postal_code": "[REDACTED_POSTAL_CODE]",
}
TYPE_LABELS = {"pii": "[REDACTED_PII]", "credential": "[REDACTED_CREDENTIAL]", "financial": "[REDACTED_FINANCIAL]", "business_intelligence": "[REDACTED_BUSINESS_DATA]"}
MODES = ("redact", "tokenize")


def _choose(value: Column, table: dict[str, str], otherwise: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in table.items() for v in kv]), value), otherwise)


def label(x: Column) -> Column:
    """What a span's label says: by pattern, else by type."""
    return _choose(x["pattern"], LABELS, _choose(x["type"], TYPE_LABELS, F.lit("[REDACTED]")))


def replacement(x: Column, text: Column | None = None) -> Column:
    """BLOCK gives the label, WARN the pattern's warning, LOG what stands there, anything else a plain mark."""
    return (
        F.when(x["severity"] == "BLOCK", label(x))
        .when(x["severity"] == "WARN", F.concat(F.lit("[WARNING_"), F.upper(x["pattern"]), F.lit("]")))
        .when(x["severity"] == "LOG", x["matched"])
        .otherwise(F.lit("[REDACTED]"))
    )


def rewritten_spans(violations: Column) -> Column:
    return F.filter(violations, lambda x: x["severity"].isin("BLOCK", "WARN"))


def spliced(text: Column, spans: Column, new: Column) -> Column:
    """text with the disjoint spans, in order, replaced by the strings of ``new``; slices are of UTF-8 bytes."""
    raw = text.cast("binary")
    before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(spans, i - 1)["end"])
    pieces = F.transform(spans, lambda x, i: F.concat(F.substring(raw, before(i) + 1, x["position"] - before(i)).cast("string"), F.get(new, i)))
    last = F.element_at(spans, -1)["end"]
    tail = F.substring(raw, last + 1, F.octet_length(raw)).cast("string")
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(F.array_join(pieces, ""), tail))


def redacted(text: Column, violations: Column) -> Column:
    spans = rewritten_spans(violations)
    return spliced(text, spans, F.transform(spans, replacement))


def resolved_mode(requested: Column | None, configured: str = "") -> Column:
    """The request's mode, else the configured one, else redact."""
    default = F.lit(configured or "redact")
    return default if requested is None else F.coalesce(F.when(requested != "", requested), default)


def sanitize(df: DataFrame, text: str = "text", patterns: list[Pattern] | None = None, keep_original: bool = True) -> DataFrame:
    """df with violations, sanitized_text, safe, redacted_count and tokenized_count (0: this never makes tokens)."""
    out = detect(df, text, patterns)
    t, v = F.coalesce(F.col(text), F.lit("")), F.col("violations")
    out = out.withColumns({
        "sanitized_text": redacted(t, v), "safe": F.size(v) == 0,
        "redacted_count": F.size(rewritten_spans(v)), "tokenized_count": F.lit(0),
    })
    return out if keep_original else out.drop(text)
