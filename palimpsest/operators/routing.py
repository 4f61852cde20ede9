"""Which provider a model name goes to, and what a provider can do: joins with small tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Prefixes of model names and their providers.
PREFIXES = (("gpt-", "openai"), ("o", "openai"), ("claude-", "anthropic"), ("gemini-", "gemini"), ("deepseek-", "deepseek"))
#: Provider, chat, chat streams, responses, response streams.
CAPABILITIES = (
    ("openai", True, True, True, True),
    ("anthropic", True, False, True, False),
    ("gemini", True, False, True, False),
    ("deepseek", True, True, True, False),
)


def routes(spark: SparkSession, exact: dict[str, str] | None = None, prefixes: tuple = PREFIXES) -> tuple[DataFrame, DataFrame]:
    return (
        spark.createDataFrame(list((exact or {}).items()), "name string, exact_provider string"),
        spark.createDataFrame(list(prefixes), "prefix string, prefix_provider string"),
    )


def route(df: DataFrame, exact: DataFrame, prefixes: DataFrame, default: str = "openai", model: str = "model") -> DataFrame:
    """df with provider: an exact name, else the longest prefix, else the default; a blank model has none.

    Each distinct model is routed once. Prefixes meet models by their leading characters: one equi-join for each prefix length
    that occurs.
    """
    lengths = [r[0] for r in prefixes.select(F.length("prefix")).distinct().collect()]
    models = df.select(F.col(model).alias("_model")).distinct()
    heads = models.select("_model", F.explode(F.array(*[F.substring("_model", 1, n) for n in lengths]) if lengths else F.array().cast("array<string>")).alias("_head"))
    best = heads.join(prefixes, heads["_head"] == prefixes["prefix"]).groupBy("_model").agg(F.max_by("prefix_provider", F.length("prefix")).alias("_by_prefix"))
    known = models.join(exact, F.col("_model") == F.col("name"), "left").join(best, "_model", "left")
    chosen = known.select("_model", F.when(F.trim("_model") != "", F.coalesce("exact_provider", "_by_prefix", F.lit(default))).alias("provider"))
    return df.join(chosen, df[model] == chosen["_model"], "left").drop("_model")


def capabilities(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CAPABILITIES), "provider string, chat boolean, chat_stream boolean, responses boolean, responses_stream boolean")


def check_capability(df: DataFrame, table: DataFrame) -> DataFrame:
    """df (provider, route, stream) with supported: what the provider says of the route, and of streams on it."""
    chat = F.when(F.col("stream"), F.col("chat_stream")).otherwise(F.col("chat"))
    responses = F.when(F.col("stream"), F.col("responses_stream")).otherwise(F.col("responses"))
    met = df.join(table, "provider", "left")
    ok = F.coalesce(F.when(F.col("route") == "chat", chat).when(F.col("route") == "responses", responses), F.lit(False))
    return met.withColumn("supported", ok).select(*df.columns, "supported")


def stream_mode(stream: Column, mode: Column) -> Column:
    """Streams never make tokens."""
    return F.when(stream, "redact").otherwise(mode)


def model_family(model: Column) -> Column:
    """The family that a model name's prefix tells."""
    family = {"anthropic": "claude"}
    out = F.lit("custom")
    for prefix, provider in reversed(PREFIXES):
        out = F.when(F.startswith(model, F.lit(prefix)), family.get(provider, provider)).otherwise(out)
    return out


def session_or_new(header: Column, prefix: str) -> Column:
    """The session of a header; a missing or invalid one gives a new session and no error."""
    from .vault import is_session_id, new_session_id

    return F.when(is_session_id(header, prefix), header).otherwise(new_session_id(prefix))


def resolve_gate(configured: Column, issued: Column, exists: Column, found: Column) -> Column:
    """What becomes of resolving an answer: skipped, success, vault_expired, no_vault or error."""
    return (
        F.when(configured != "tokenize", "skipped").when(found, "success")
        .when(issued > 0, "error").when(exists, "vault_expired").otherwise("no_vault")
    )
