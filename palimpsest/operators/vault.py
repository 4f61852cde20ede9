"""Session vaults as tables: which token stands for which value in a session, and back.

Numbering needs no loop. A counter of a session rises only when a value is seen for the first time, so a value's number is its
rank among the session's first sightings of its family; requests count in order, and within a request spans from the end of the
text to its start. Two exchanges by session: one for first sightings and ranks, one to bring the tokens back to the requests.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.sources.patterns import Pattern
from palimpsest.sources.stored import stored

from .detect import detect, one_by_one
from .rewrite import label, rewritten_spans, spliced
from .tokens import family, fragments_of, token_of

MAX_TOKENS = 100_000
PREFIX = "vlt_"
#: Rows of a session that one part resolves.
ROWS_PER_PART = 100_000


def new_session_id(prefix: str = PREFIX) -> Column:
    return F.concat(F.lit(prefix), F.uuid())


def is_session_id(value: Column, prefix: str = PREFIX) -> Column:
    return F.coalesce(value.rlike(rf"\A{prefix}[0-9a-fA-F-]{{36}}\z"), F.lit(False))


def tokenized_spans(violations: Column) -> Column:
    """Spans that get tokens: credentials never do."""
    return F.filter(rewritten_spans(violations), lambda x: x["type"] != "credential")


def sightings(detected: DataFrame, session: str, order: str) -> DataFrame:
    """session, matched, pattern, ord of every span that gets a token. ord: (request order, minus position)."""
    named = detected.select(F.col(session).alias("session_id"), F.col(order).alias("req"), tokenized_spans(F.col("violations")).alias("v"))
    spans = one_by_one(named, "v", "session_id", "req")
    return spans.select("session_id", F.col("x.matched").alias("matched"), F.col("x.pattern").alias("pattern"), F.struct("req", (-F.col("x.position")).alias("back")).alias("ord"))


def vault_tokens(seen: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """session_id, matched, pattern, gen_key, seq, ord, token, error for every value of every session.

    A value whose counter has no room has an error and no token, but uses its number up; values beyond the vault's capacity
    have the error vault_full.
    """
    first = seen.groupBy("session_id", "matched").agg(F.min("ord").alias("ord"), F.min_by("pattern", "ord").alias("pattern"))
    keyed = first.withColumn("gen_key", family(F.col("pattern")))
    ranked = keyed.withColumns({
        "seq": F.row_number().over(Window.partitionBy("session_id", "gen_key").orderBy("ord", "matched")),
        "nth": F.row_number().over(Window.partitionBy("session_id").orderBy("ord", "matched")),
    })
    made = ranked.withColumn("made", token_of("matched", "gen_key", "seq"))
    full = F.col("nth") > max_tokens
    return made.select(
        "session_id", "matched", "pattern", "gen_key", "seq", "ord",
        F.when(~full, F.col("made.token")).alias("token"), F.when(full, "vault_full").otherwise(F.col("made.error")).alias("error"),
    )


def vault_subtokens(tokens: DataFrame) -> DataFrame:
    """session_id, fragment, original of fragments of e-mail tokens, folded in order of sightings: a second, different meaning
    deletes a fragment, a third sets it anew. Fragments that mean themselves or that are whole tokens are left out."""
    parts = tokens.where("token IS NOT NULL").select("session_id", "ord", F.explode(fragments_of("matched", "token", "gen_key")).alias("f")).select("session_id", "ord", "f.*").where("fragment <> original")
    ordered = parts.groupBy("session_id", "fragment").agg(F.array_sort(F.collect_list(F.struct("ord", "original"))).alias("seen"))
    folded = F.aggregate("seen", F.lit(None).cast("string"), lambda s, x: F.when(s.isNull() | (s == x["original"]), x["original"]))
    kept = ordered.select("session_id", "fragment", folded.alias("original")).where("original IS NOT NULL")
    return kept.join(tokens.select("session_id", F.col("token").alias("fragment")), ["session_id", "fragment"], "left_anti")


def reverse_map(tokens: DataFrame, subtokens: DataFrame) -> DataFrame:
    """session_id and a map of everything that resolves: fragments, overlaid by tokens. Of values that share a token the last holds."""
    whole = tokens.where("token IS NOT NULL").groupBy("session_id", F.col("token").alias("k")).agg(F.max_by("matched", "ord").alias("v"))
    both = whole.unionByName(subtokens.select("session_id", F.col("fragment").alias("k"), F.col("original").alias("v")))
    return both.groupBy("session_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("reverse"))


def tokenize(df: DataFrame, text: str = "text", session: str = "session_id", order: str = "request_order", patterns: list[Pattern] | None = None, max_tokens: int = MAX_TOKENS) -> tuple[DataFrame, DataFrame]:
    """(df with sanitized_text, redacted_count, tokenized_count, safe and error; the vault's tokens).

    (session, order) names a request. A request with a value that has no token has an error and no text. Detection runs once: its
    result is written, and three branches read it.
    """
    detected = stored(detect(df, text, patterns), "detected")
    tokens = vault_tokens(sightings(detected, session, order), max_tokens)
    keyed = detected.select(F.col(session).alias("session_id"), F.col(order).alias("req"), F.array_distinct(F.transform(tokenized_spans(F.col("violations")), lambda x: x["matched"])).alias("v"))
    keyed = one_by_one(keyed, "v", "session_id", "req").withColumnRenamed("x", "matched")
    found = keyed.join(tokens.select("session_id", "matched", "token", "error"), ["session_id", "matched"])
    known = found.groupBy("session_id", "req").agg(F.map_from_entries(F.collect_list(F.struct("matched", F.coalesce("token", F.lit(""))))).alias("_tokens"), F.min("error").alias("error"))
    met = detected.join(known.withColumnsRenamed({"session_id": "_session", "req": "_req"}), F.col(session).eqNullSafe(F.col("_session")) & F.col(order).eqNullSafe(F.col("_req")), "left")
    t, spans = F.coalesce(F.col(text), F.lit("")), rewritten_spans(F.col("violations"))
    new = F.transform(spans, lambda x: F.when(x["type"] == "credential", label(x)).otherwise(F.element_at("_tokens", x["matched"])))
    # A value without a token (a request without a session, for one) is an error too, never a label.
    lost = F.exists(new, lambda n: n.isNull())
    met = met.withColumn("error", F.coalesce("error", F.when(lost, "token_missing")))
    out = met.withColumns({
        "sanitized_text": F.when(F.col("error").isNull(), spliced(t, spans, new)),
        "safe": F.size("violations") == 0, "redacted_count": F.size(spans), "tokenized_count": F.size(tokenized_spans(F.col("violations"))),
    })
    return out.drop("_session", "_req", "_tokens"), tokens


def replaced(body: str, keys: ahocorasick.Automaton) -> str:
    """body with every key replaced by its value in one pass: of keys that begin at one place the longest, from left to right."""
    # (The automaton's own longest-match mode overlooks keys behind an unfinished longer one.)
    found = sorted((end + 1 - size, -size, value) for end, (size, value) in keys.iter(body))
    out, at = [], 0
    for begin, less, value in found:
        if begin >= at:
            out.append(body[at:begin])
            out.append(value)
            at = begin - less
    return "".join(out) + body[at:] if out else body


def _resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(session, part, kind, key, value, row, body), sorted: a session's entries (kind 0) come before its rows (kind 1)."""
    last, entries, keys = None, {}, None
    for b in batches:
        rows, out = [], []
        for i, (session, part, kind) in enumerate(zip(*(b.column(k).to_pylist() for k in range(3)), strict=True)):
            if (session, part) != last:
                last, entries, keys = (session, part), None, None
            if not kind:
                entries = {} if entries is None else entries
                key = b.column(3)[i].as_py()
                if key:
                    entries[key] = b.column(4)[i].as_py() or ""
                continue
            if entries and keys is None:
                keys = ahocorasick.Automaton()
                for key, value in entries.items():
                    keys.add_word(key, (len(key), value))
                keys.make_automaton()
            body = b.column(6)[i].as_py()
            rows.append(i)
            out.append((None if entries is None or body is None else replaced(body, keys) if keys else body, "vault_expired" if entries is None else "success"))
        yield pa.RecordBatch.from_arrays([b.column(5).take(pa.array(rows, pa.int64())), pa.array([t for t, _ in out], pa.string()), pa.array([s for _, s in out], pa.string())], ["row", "resolved_text", "resolve_status"])


def resolve(df: DataFrame, reverse: DataFrame, body: str = "body", session: str = "session_id", rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """df with resolved_text and resolve_status: success, or vault_expired where the session has no vault.

    A session's entries and rows meet sorted, entries first: they become one automaton (Aho-Corasick), which goes through each
    body once whatever the number of tokens. A session with many rows is dealt to several parts, each with all of its entries.
    """
    parts = df.where(F.col(session).isNotNull()).groupBy(F.col(session).cast("string").alias("_s")).agg(F.ceil(F.count("*") / F.lit(rows_per_part)).cast("long").alias("_parts"))
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    nothing = F.lit(None).cast("string")
    # Rows without a session are spread by their content; they meet no entries.
    named = df.select(row.alias("row"), F.col(session).cast("string").alias("_s"), F.col(body).alias("_body"))
    many = parts.where("_parts > 1")
    met = named.join(many, "_s", "left").withColumn("_part", F.pmod(F.xxhash64("_body", F.monotonically_increasing_id()), F.when(F.col("_s").isNull(), 1 << 20).otherwise(F.coalesce("_parts", F.lit(1)))))
    bodies = met.select("_s", "_part", F.lit(1).alias("_kind"), nothing.alias("_key"), nothing.alias("_value"), "row", "_body")
    entries = reverse.select(F.col("session_id").cast("string").alias("_s"), F.explode(F.concat(F.array(F.struct(nothing.alias("key"), nothing.alias("value"))), F.map_entries("reverse"))).alias("e"))
    dealt = entries.join(parts, "_s").select("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("_part"), F.lit(0).alias("_kind"), F.col("e.key").alias("_key"), F.col("e.value").alias("_value"), F.lit(None).cast(met.schema["row"].dataType).alias("row"), nothing.alias("_body"))
    sorted_ = bodies.unionByName(dealt).repartition("_s", "_part").sortWithinPartitions("_s", "_part", "_kind")
    schema = T.StructType([met.schema["row"], T.StructField("resolved_text", T.StringType()), T.StructField("resolve_status", T.StringType())])
    return sorted_.mapInArrow(_resolved, schema).select("row.*", "resolved_text", "resolve_status")


def live(vaults: DataFrame, now: Column, expires: str = "expires_at") -> DataFrame:
    """Vaults that haven't expired: the time of expiry itself is too late."""
    return vaults.where(F.col(expires) > now)


def with_sessions(df: DataFrame, sessions: DataFrame, session: str = "session_id") -> DataFrame:
    """Rows whose session exists."""
    return df.join(sessions.select(session).distinct(), session, "left_semi")
