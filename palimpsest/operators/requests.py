"""Batches of requests as tables: checks of the envelope and of each item, partial success, and the summary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .rewrite import MODES, resolved_mode, sanitize
from .vault import PREFIX, is_session_id, new_session_id, tokenize

ITEM = "item_index int, id string, prompt string, session_id string, sanitization_mode string, slm boolean"
_FIELDS = {"id", "prompt", "session_id", "sanitization_mode", "slm"}


@dataclass(frozen=True)
class Limits:
    max_items: int = 100
    max_prompt_bytes: int = 65536
    max_body_bytes: int = 1048576


class BadRequest(ValueError):
    """An envelope that is refused as a whole; status is what an HTTP server would answer."""

    def __init__(self, status: int, reason: str):
        super().__init__(reason)
        self.status = status


#: A column of item fields: types that a field may have besides null.
_TYPES = {"id": "STRING", "prompt": "STRING", "session_id": "STRING", "sanitization_mode": "STRING", "slm": "BOOLEAN"}
_OBJECT = "map<string,variant>"


def whole_json(body: Column) -> Column:
    """body as VARIANT; null if it is no JSON or goes on behind its end.

    The parser stops at the end of a value, so the body is put into an array before its own digest: only a body that is one whole
    value leaves exactly the two.
    """
    seal = F.sha2(body, 256)
    pair = F.try_parse_json(F.concat(F.lit("["), body, F.lit(',"'), seal, F.lit('"]')))
    two = F.try_variant_get(pair, "$", "array<variant>")
    whole = (F.size(two) == 2) & (F.try_variant_get(F.get(two, F.lit(1)), "$", "string") == seal)
    return F.when(whole, F.get(two, F.lit(0)))


def envelopes(bodies: DataFrame, body: str = "body", limits: Limits = Limits()) -> DataFrame:
    """bodies with status (what an HTTP server would answer: 200, 400 or 413), reason (null for 200) and items (array<ITEM>).

    An envelope is an object whose only field is ``items``, a list of objects with known fields of their types; null counts as
    absent. What is refused is refused as a whole and has no items. Everything is expressions over a VARIANT: a table of requests is read without Python.
    """
    keys = lambda v: F.map_keys(F.try_variant_get(v, "$", _OBJECT))
    read = bodies.withColumn("_v", F.when(F.octet_length(body) <= limits.max_body_bytes, whole_json(F.col(body))))
    read = read.withColumns({"_keys": keys(F.col("_v")), "_list": F.try_variant_get("_v", "$.items", "array<variant>"), "_kind": F.schema_of_variant(F.try_variant_get("_v", "$.items", "variant"))})
    field = lambda x, name: F.try_variant_get(x, f"$.{name}", "variant")
    unknown = lambda x: keys(x).isNull() | (F.size(F.array_except(keys(x), F.array(*map(F.lit, sorted(_FIELDS))))) > 0)

    def mistyped(x: Column) -> Column:
        out = F.lit(False)
        for name, kind in _TYPES.items():
            out |= ~F.coalesce(F.schema_of_variant(field(x, name)), F.lit("VOID")).isin(kind, "VOID")
        return out

    reason = (
        F.when(F.octet_length(body) > limits.max_body_bytes, "body too large").when(F.col("_v").isNull(), "invalid JSON")
        .when(F.col("_keys").isNull() | (F.size(F.array_except("_keys", F.array(F.lit("items")))) > 0) | (F.col("_list").isNull() & ~F.coalesce("_kind", F.lit("VOID")).isin("VOID")), "unknown field")
        .when(F.coalesce(F.size("_list"), F.lit(0)) <= 0, "no items").when(F.size("_list") > limits.max_items, "too many items")
        .when(F.exists("_list", unknown), "unknown field").when(F.exists("_list", mistyped), "invalid JSON")
    )
    item = lambda x, i: F.struct(i.alias("item_index"), *[F.try_variant_get(x, f"$.{n}", "boolean" if n == "slm" else "string").alias(n) for n in ("id", "prompt", "session_id", "sanitization_mode", "slm")])
    judged = read.withColumn("reason", reason)
    status = F.when(F.col("reason").isNull(), 200).when(F.col("reason") == "body too large", 413).otherwise(400)
    return judged.withColumns({"status": status, "items": F.when(F.col("reason").isNull(), F.transform("_list", item))}).drop("_v", "_keys", "_list", "_kind")


def envelope_items(read: DataFrame, *keys: str) -> DataFrame:
    """A row for each item of the envelopes that hold: the named columns and ITEM."""
    return read.where("status = 200").select(*keys, F.explode("items").alias("x")).select(*keys, "x.*")


def read_envelope(spark: SparkSession, body: str, limits: Limits = Limits()) -> DataFrame:
    """The items of one JSON envelope, or BadRequest."""
    read = envelopes(spark.createDataFrame([(body,)], "body string"), limits=limits)
    answer = read.select("status", "reason").first()
    if answer.reason is not None:
        raise BadRequest(answer.status, answer.reason)
    return envelope_items(read)


def item_error(limits: Limits = Limits(), prefix: str = PREFIX) -> Column:
    """The first check that an item fails, in order; null if none."""
    session, mode = F.coalesce("session_id", F.lit("")), F.coalesce("sanitization_mode", F.lit(""))
    return (
        F.when(F.coalesce("prompt", F.lit("")) == "", "missing_prompt")
        .when(F.octet_length("prompt") > limits.max_prompt_bytes, "prompt_too_large")
        .when((session != "") & ~is_session_id(session, prefix), "invalid_session_id")
        .when((mode != "") & ~mode.isin(*MODES), "invalid_sanitization_mode")
    )


def store_error(status: Column) -> Column:
    """An item's error by how its session's vault was read or saved (the status of unsealed vaults and of judged saves).

    A store that is away, or a save that lost all its tries, can be asked again; a vault that doesn't open, or is corrupt, can't.
    """
    return F.when(status.isin("unavailable", "conflict"), "session_store_unavailable").when(status.isin("unknown_key", "wrong_key", "corrupt"), "sanitization_failed")


def checked_items(items: DataFrame, mode: str = "redact", limits: Limits = Limits(), prefix: str = PREFIX, stored: DataFrame | None = None) -> DataFrame:
    """items with error_code and mode. stored: session_id and status of vaults; of several statuses of a session the gravest by
    store_error counts, an absent vault is a new one, and only items that make tokens need it."""
    out = items.withColumn("error_code", item_error(limits, prefix)).withColumn("mode", resolved_mode(F.col("sanitization_mode"), mode))
    if stored is None:
        return out
    # "sanitization_failed" sorts before "session_store_unavailable": what can't be mended by another try goes first.
    bad = stored.groupBy(F.col("session_id").alias("_session")).agg(F.min(store_error(F.col("status"))).alias("_store")).where("_store IS NOT NULL")
    needs = F.when((F.col("mode") == "tokenize") & F.col("error_code").isNull(), F.col("session_id"))
    met = out.withColumn("_needs", needs).join(bad, F.col("_needs") == F.col("_session"), "left")
    return met.withColumn("error_code", F.coalesce("error_code", "_store")).drop("_needs", "_session", "_store")


def run_batch(items: DataFrame, mode: str = "redact", limits: Limits = Limits(), prefix: str = PREFIX, stored: DataFrame | None = None) -> DataFrame:
    """item_index, id, ok, error_code, sanitized_prompt, violations, counts, session_id. The original prompt isn't returned, and
    items that fail don't stop others. Items without a session share none: each that makes tokens gets a session of its own."""
    checked = checked_items(items, mode, limits, prefix, stored)
    good = checked.where("error_code IS NULL")
    columns = ["item_index", "id", "ok", "error_code", "sanitized_prompt", "violations", "redacted_count", "tokenized_count", "session_id", "mode"]
    plain = sanitize(good.where("mode = 'redact'"), "prompt").withColumns({"ok": F.lit(True), "session_id": F.lit(None).cast("string")})
    named = good.where("mode = 'tokenize'").withColumn("session_id", F.coalesce(F.when(F.col("session_id") != "", F.col("session_id")), new_session_id(prefix)))
    made, _ = tokenize(named, "prompt", "session_id", "item_index")
    made = made.withColumn("ok", F.col("error").isNull()).withColumn("error_code", F.when(~F.col("ok"), "sanitization_failed"))
    bad = checked.where("error_code IS NOT NULL").withColumns({
        "ok": F.lit(False), "sanitized_prompt": F.lit(None).cast("string"), "violations": F.lit(None).cast(plain.schema["violations"].dataType),
        "redacted_count": F.lit(0), "tokenized_count": F.lit(0),
    })
    frames = [x.withColumnRenamed("sanitized_text", "sanitized_prompt").select(*columns) for x in (plain, made, bad)]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


def summary(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"),
        F.coalesce(F.sum(F.when(F.col("ok"), F.size("violations"))), F.lit(0)).alias("violations"),
        F.coalesce(F.sum(F.when(F.col("ok"), F.col("redacted_count"))), F.lit(0)).alias("redacted"),
        F.coalesce(F.sum(F.when(F.col("ok"), F.col("tokenized_count"))), F.lit(0)).alias("tokenized"),
    )


def mode_aggregates() -> list[Column]:
    """How many items ask for each mode, and how many for the contextual model."""
    return [*[F.count_if(F.coalesce("sanitization_mode", F.lit("")) == m).alias(m) for m in MODES], F.count_if(F.coalesce("slm", F.lit(False))).alias("slm")]


def mode_counts(items: DataFrame) -> DataFrame:
    return items.agg(*mode_aggregates())


def request_totals(df: DataFrame, request: str) -> DataFrame:
    """Sums over the messages of each request."""
    return df.groupBy(request).agg(F.sum(F.size("violations")).alias("violations"), F.sum("redacted_count").alias("redacted"), F.sum("tokenized_count").alias("tokenized"))


def numbered(df: DataFrame, request: str, order: str) -> DataFrame:
    """df with item_index, the place of each row in its request."""
    return df.withColumn("item_index", F.row_number().over(Window.partitionBy(request).orderBy(order)) - 1)
