"""Reports: diffs, summaries and lists as text, counts of kinds, and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .rewrite import rewritten_spans

SAFE_LINE = "✓ Input is safe - no sensitive data detected"


def changes(violations: Column) -> Column:
    """array<struct<position, old_text, new_text, length>> of spans that were rewritten."""
    return F.transform(rewritten_spans(violations), lambda x: F.struct(x["position"].alias("position"), x["matched"].alias("old_text"), F.lit("[REDACTED]").alias("new_text"), (x["end"] - x["position"]).alias("length")))


def diff_text(before: Column, after: Column, n_changes: Column, colours: bool = False) -> Column:
    """Lines of both texts side by side by number; unchanged lines once."""
    red, green, bold, plain = ("\033[31m", "\033[32m", "\033[1m", "\033[0m") if colours else ("", "", "", "")
    gap = " " if colours else ""
    pairs = F.arrays_zip(F.split(before, "\n", -1).alias("a"), F.split(after, "\n", -1).alias("b"))

    def line(p: Column) -> Column:
        a, b = F.coalesce(p["a"], F.lit("")), F.coalesce(p["b"], F.lit(""))
        gone = F.when(a != "", F.concat(F.lit(f"{red}-{gap}"), a, F.lit(f"\n{plain}"))).otherwise("")
        new = F.when(b != "", F.concat(F.lit(f"{green}+{gap}"), b, F.lit(f"\n{plain}"))).otherwise("")
        return F.when(a == b, F.concat(F.lit(f" {gap}"), a, F.lit("\n"))).otherwise(F.concat(gone, new))

    body = F.array_join(F.transform(pairs, line), "")
    if colours:
        text = F.concat(F.lit(f"{bold}Sanitization Changes:\n{plain}\n"), body, F.lit(f"\n{bold}Total changes: "), n_changes.cast("string"), F.lit(f"\n{plain}"))
        return F.when(n_changes == 0, f"{green}No changes - input is safe{plain}").otherwise(text)
    return F.when(n_changes == 0, "No changes").otherwise(F.concat(F.lit("--- Original\n+++ Sanitized\n\n"), body))


def summary_text(text: Column, sanitized: Column, violations: Column, ms: Column) -> Column:
    redacted = F.size(rewritten_spans(violations))
    long = F.format_string(
        "⚠ Sanitized %d violation(s) in %.2fms\n  - Total violations: %d\n  - Redacted: %d\n  - Original length: %d chars\n  - Sanitized length: %d chars",
        redacted, ms.cast("double"), F.size(violations), redacted, F.octet_length(text), F.octet_length(sanitized),
    )
    return F.when(F.size(violations) == 0, SAFE_LINE).otherwise(long)


def violation_list(violations: Column) -> Column:
    """A numbered list; matched texts of more than 50 bytes end in three points."""
    cut = lambda m: F.when(F.octet_length(m) <= 50, m).otherwise(F.concat(F.substring(m.cast("binary"), 1, 47).cast("string"), F.lit("...")))
    item = lambda x, i: F.format_string('%d. [%s] %s\n   Type: %s\n   Position: %d\n   Matched: "%s"\n\n', i + 1, x["severity"], x["pattern"], x["type"], x["position"], cut(x["matched"]))
    return F.when(F.size(violations) == 0, "No violations found").otherwise(F.concat(F.lit("Violations Detected:\n\n"), F.array_join(F.transform(violations, item), "")))


def type_counts(violations: Column) -> Column:
    """type:count of each kind, sorted as text and joined by commas."""
    kinds = F.array_distinct(F.transform(violations, lambda x: x["type"]))
    pair = lambda t: F.concat(t, F.lit(":"), F.size(F.filter(violations, lambda x: x["type"] == t)).cast("string"))
    return F.array_join(F.array_sort(F.transform(kinds, pair)), ",")


def headers(violations: Column, redacted: Column, tokenized: Column, mode: Column) -> Column:
    """What a proxy's answer says about a request."""
    return F.struct(F.size(violations).alias("violations_found"), redacted.alias("redacted"), mode.alias("mode"), tokenized.alias("tokens_issued"), type_counts(violations).alias("summary"))


def events(df: DataFrame, request: str) -> DataFrame:
    """Two server-sent events for each request with violations: the report, then its violations."""
    report = F.to_json(F.struct(F.lit("violation_report").alias("object"), F.size("violations").alias("violations_found"), type_counts(F.col("violations")).alias("summary")))
    each = F.to_json(F.struct(F.lit("violation").alias("object"), F.col("violations")))
    lines = F.transform(F.array(report, each), lambda x: F.concat(F.lit("data: "), x, F.lit("\n\n")))
    return df.where(F.size("violations") > 0).select(request, F.posexplode(lines).alias("event_index", "event"))


def counters() -> list[Column]:
    """Requests, violations, rewritten spans and safe requests, as aggregates of sanitized rows."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return [F.count(F.lit(1)).alias("requests_total"), total(F.size("violations")).alias("violations_total"), total("redacted_count").alias("redacted_total"), F.count_if("safe").alias("safe_total")]


def metrics_text(df: DataFrame, prefix: str = "sanitizer") -> DataFrame:
    """One row of text in the exposition format: requests, violations, rewritten spans, safe requests."""
    totals = df.agg(*counters())
    line = lambda n: F.concat(F.lit(f"# TYPE {prefix}_{n} counter\n{prefix}_{n} "), F.col(n).cast("string"), F.lit("\n"))
    return totals.select(F.concat(*[line(n) for n in totals.columns]).alias("text"))


def observed(df: DataFrame) -> tuple[DataFrame, Observation]:
    """df, and its counters, which fill as df is written: no second pass. For observed_text once the action has ended."""
    counts = Observation()
    return df.observe(counts, *counters()), counts


def observed_text(counts: Observation, prefix: str = "sanitizer") -> str:
    """The text of metrics_text from what was counted along with an action; waits for the action."""
    return "".join(f"# TYPE {prefix}_{n} counter\n{prefix}_{n} {v}\n" for n, v in counts.get.items())


def average_latency(df: DataFrame, ms: str) -> DataFrame:
    return df.agg(F.coalesce(F.avg(ms), F.lit(0.0)).alias("average_ms"), F.count(ms).alias("n"))


def redacted_query(url_query: Column) -> Column:
    """A URL's query with the values of its sensitive keys replaced, its pairs in order of keys."""
    sensitive = ("key", "api_key", "apikey", "access_token", "token", "auth", "authorization")
    pairs = F.transform(F.filter(F.split(url_query, "&"), lambda p: p != ""), lambda p, i: F.struct(F.regexp_extract(p, "^([^=]*)", 1).alias("k"), i.alias("i"), F.regexp_extract(p, "^[^=]*=?(.*)$", 1).alias("v")))
    shown = lambda x: F.concat(x["k"], F.lit("="), F.when(F.lower(F.try_url_decode(x["k"])).isin(*sensitive), F.lit("%5BREDACTED%5D")).otherwise(x["v"]))
    return F.array_join(F.transform(F.array_sort(pairs), shown), "&")
