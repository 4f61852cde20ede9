"""URL filters, with DataFrame functions only.

A URL is expanded into host suffixes and path prefixes. Each expression's digest is cut to a short prefix, on which the
expressions are equi-joined with the rules; what meets there is confirmed by the full digest of the rule's own host and path,
and the longest confirmed rule decides. A rule's key is its host and its path up to the last slash, so the prefixes at slashes
reach every rule, and the full digest settles whether the rest of the rule's path follows.

Rules for odd rows: a null URL, or one without ``://``, has an empty host and path and meets no rule; rows that repeat an id or
a URL each get their verdict; an empty table of pages gives an empty result, and without rules every URL gets the default
verdict; further columns of pages are ignored, whatever their names. Rules that state the same host and path twice must agree:
of two verdicts the lesser in order of code points holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Hexadecimal digits of a digest that the join uses.
SHORT = 8
#: (host, path, verdict) of the query's rules.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: The verdict on a URL that no rule fits.
DEFAULT = "allow"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case. Path: then up to ``?``, ``#`` or the end."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def keyed_rules(rules: DataFrame) -> DataFrame:
    """rules (host, path, verdict) with their join key, full digest and depth."""
    base = F.regexp_extract("path", r"(?s)\A(.*/)?", 0)
    return rules.groupBy("host", "path").agg(F.min("verdict").alias("verdict")).select(
        F.concat("host", "path").alias("rule"), "verdict", F.length("path").alias("path_length"),
        (F.length("host") + F.length("path")).alias("rule_length"), _digest(F.col("host"), F.col("path")).alias("rule_digest"),
        F.substring(_digest(F.col("host"), base), 1, SHORT).alias("key"),
        F.size(F.split("host", r"\.")).alias("labels"), F.size(F.split(base, "/")).alias("slashes"),
    )


def judged(pages: DataFrame, rules: DataFrame, url_column: str = "url", default: str = DEFAULT) -> DataFrame:
    """pages (struct ``row``) with host, path, rule and verdict.

    Only hosts and paths that some rule fits go through the expansion's shuffle; each is judged once, whatever the number of
    pages that have it. Suffixes and prefixes deeper than any rule are not expanded: no rule can equal them.
    """
    keyed = keyed_rules(rules)
    deepest = keyed.agg(F.max("labels"), F.max("slashes")).first()
    labels, slashes = (deepest[0] or 0), (deepest[1] or 0)
    host, path = host_and_path(F.col(f"`{url_column}`"))
    seen = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"), host.alias("host"), path.alias("path"))
    if not labels:
        return seen.select("row", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))

    parts, steps = F.split("host", r"\."), F.split("path", "/")
    n, m = F.size(parts), F.size(steps)
    suffixes = F.transform(F.sequence(F.greatest(F.lit(1), n - labels + 1), n), lambda i: F.array_join(F.slice(parts, i, n), "."))
    prefixes = F.transform(F.sequence(F.lit(0), F.least(m - 1, F.lit(slashes))), lambda i: F.when(i == 0, "").otherwise(F.concat(F.array_join(F.slice(steps, 1, i), "/"), F.lit("/"))))
    pairs = seen.where("host <> ''").select("host", "path").distinct()
    expanded = pairs.select("host", "path", F.explode(suffixes).alias("suffix"), prefixes.alias("prefixes")).select("host", "path", "suffix", F.explode("prefixes").alias("prefix"))
    expanded = expanded.withColumn("key", F.substring(_digest(F.col("suffix"), F.col("prefix")), 1, SHORT))
    met = expanded.join(keyed, "key")
    fits = (F.length("path") >= F.col("path_length")) & (_digest(F.col("suffix"), F.col("path").substr(F.lit(1), F.col("path_length"))) == F.col("rule_digest"))
    best = met.where(fits).groupBy("host", "path").agg(F.max(F.struct("rule_length", "rule", "verdict")).alias("best"))
    verdicts = best.select(F.col("host").alias("v_host"), F.col("path").alias("v_path"), "best.rule", "best.verdict")
    joined = seen.join(verdicts, (F.col("host") == F.col("v_host")) & (F.col("path") == F.col("v_path")), "left")
    return joined.select("row", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def rules_frame(spark: SparkSession, rules: tuple = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judged(pages, rules_frame(spark)).select("row.page_id", "host", "path", "rule", "verdict")


def queries() -> dict:
    return {"op4_url_filter": op4_url_filter}


ORACLE = """
WITH r AS (SELECT * FROM (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')) AS t(rh, rp, v)),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages))
SELECT page_id, host, path,
  (SELECT arg_max(rh || rp, length(rh) + length(rp)) FROM r WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) AS rule,
  coalesce((SELECT arg_max(v, length(rh) + length(rp)) FROM r WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)), 'allow') AS verdict
FROM p
"""


def oracle_sql() -> dict:
    return {"op4_url_filter": ORACLE}
