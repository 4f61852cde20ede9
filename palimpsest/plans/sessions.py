"""Queries of sessions over the conversations: life cycle, calls to stores, resolving, and decoding of tagged tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import contextual, lifecycle, requests, rewrite, saves, sealed, vault
from palimpsest.operators.spans import placed_matches
from palimpsest.sources import settings
from palimpsest.streaming import vault_stream

#: Conversations have no times: one begins every START_S seconds, and its turns follow at growing distances, the fifth after more
#: than the time to live.
START_S, GROWTH_S = 97, 450
STORES, STORE_ROOM = 4, 6
#: Documents as requests: seconds from one to the next, and more after every hundred.
STEP_S, PAUSE_S = 40, 4000
#: Documents of a streamed session, and of each of its vaults.
SESSION_DOCS, EPOCH_DOCS = 60, 20
#: Tags that words of a conversation get by their hash.
TAGS = ["O", "B-private_person", "I-private_person", "E-private_person", "S-secret", "I-secret", "private_url", "U-private_date", "L-private_person", "I-private_person", "", "O-other"]
WORD = r"[^\x20\x09-\x0D]+"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def _timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("turn").cast("long")
    return _turns(spark, sf_dir).select(F.col("conv_id").cast("string").alias("session_id"), turn.alias("request_order"), "text", "conv_id", F.timestamp_seconds(F.col("conv_id") * START_S + turn * turn * GROWTH_S).alias("at"))


def vault_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every session's vaults, and how many were live when each began."""
    seconds = lambda c: F.unix_seconds(c).alias(c)
    return lifecycle.vaults(_timed(spark, sf_dir)).select("session_id", "epoch", seconds("started_at"), seconds("expires_at"), "requests", "live")


def vault_epoch_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as sessions, documents as requests, a pause after every hundred: how many values of each family an epoch has, numbered
    from 1 again in each."""
    i = F.col("doc_id")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("source IS NOT NULL").select(F.col("source").alias("session_id"), i.alias("request_order"), "text", F.timestamp_seconds(i * STEP_S + F.floor(i / 100) * PAUSE_S).alias("at"))
    _, tokens = lifecycle.tokenize_with_expiry(docs)
    return tokens.groupBy("session_id", "epoch", "gen_key").agg(F.count("*").alias("n"), F.min("seq").cast("long").alias("first"), F.max("seq").cast("long").alias("last"))


def streamed_vault_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as requests of many sessions through the stream's state, as one batch: how many values of each family a vault has."""
    i = F.col("doc_id")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.floor(i / SESSION_DOCS).cast("string").alias("session_id"), i.alias("request_order"), "text", F.timestamp_seconds(i * STEP_S + F.floor(i / EPOCH_DOCS) * PAUSE_S).alias("at"))
    out = vault_stream.tokenized_stream(docs, at="at")
    new = out.select("session_id", "epoch", F.explode("made").alias("m"))
    return new.groupBy("session_id", "epoch", "m.gen_key").agg(F.count("*").alias("n"), F.min("m.seq").alias("first"), F.max("m.seq").alias("last"))


def vault_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls to stores of little room: which are refused, and which find no vault."""
    both = F.col("conv_id") + F.col("request_order")
    action = F.when(both % 11 == 10, "delete").when(both % 5 == 4, "get").otherwise("begin")
    calls = _timed(spark, sf_dir).withColumns({"store": F.col("conv_id") % STORES, "action": action})
    out = lifecycle.replayed(calls, max_vaults=STORE_ROOM)
    return out.select("store", "session_id", "request_order", "action", "epoch", "status")


def _keys(text: Column) -> Column:
    words = F.array_distinct(F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0)), lambda w: F.length(w) >= 4))
    return F.array_distinct(F.concat(words, F.transform(words, lambda w: F.substring(w, 1, 3))))


def resolved_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns in which the words of the first turn, and their beginnings, are resolved to bracketed ones."""
    turns = _turns(spark, sf_dir)
    keys = turns.where("turn = 0").select(F.col("conv_id").cast("string").alias("session_id"), _keys(F.col("text")).alias("k")).where(F.size("k") > 0)
    reverse = keys.select("session_id", F.map_from_entries(F.transform("k", lambda k: F.struct(k, F.concat(F.lit("<"), k, F.lit(">"))))).alias("reverse"))
    bodies = turns.select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").cast("long").alias("turn"), F.col("text").alias("body"))
    return vault.resolve(bodies, reverse).select("session_id", "turn", "resolved_text", "resolve_status")


def bioes_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans decoded from words whose tags come from their hashes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    tags = F.array(*[F.lit(t) for t in TAGS])

    def token(w: Column, i: Column) -> Column:
        h = F.conv(F.substring(F.md5(F.concat(w["matched"], F.lit("|"), i.cast("string"))), 1, 7), 16, 10).cast("long")
        begin = F.when((i > 0) & (h % 3 == 0), w["position"] - 1).otherwise(w["position"])
        return F.struct(begin.alias("start"), w["end"].alias("end"), F.when(h % 7 == 0, 0).otherwise(1).alias("mask"), F.get(tags, (h % len(TAGS)).cast("int")).alias("tag"), ((h % 97).cast("double") / 97).alias("score"))

    words = placed_matches(text, WORD, size=F.length)
    rows = _turns(spark, sf_dir).select("conv_id", "turn", text.alias("text"), F.transform(words, token).cast(f"array<{contextual.TOKEN}>").alias("tokens"))
    spans = rows.select("conv_id", "turn", F.explode(contextual.decoded("text", "tokens")).alias("s"))
    return spans.select("conv_id", "turn", "s.label", "s.text", "s.start", "s.end", F.round(F.col("s.score") * 1e6).cast("long").alias("score"))


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch request for each conversation; most kinds of conversations, by id, break their request in some way."""
    text = F.coalesce(F.col("text"), F.lit(""))
    fields = [F.concat_ws("-", "conv_id", "turn").alias("id"), text.alias("prompt"), F.when(F.col("turn") == 2, "vlt_no").when(F.col("turn") == 3, f"vlt_{'0' * 36}").alias("session_id"), F.when(F.col("turn") == 4, "other").when(F.col("turn") == 5, "tokenize").alias("sanitization_mode"), (F.col("turn") == 1).alias("slm")]
    turns = _turns(spark, sf_dir).select("conv_id", F.struct("turn", F.to_json(F.struct(*fields)).alias("item")).alias("x")).groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    items = F.array_join(F.transform("xs", lambda x: x["item"]), ",")
    whole = F.concat(F.lit('{"items":['), items, F.lit("]}"))
    kind = F.col("conv_id") % 12
    broken = {
        1: F.concat(whole, F.lit(" {}")), 2: F.expr("substring(whole, 1, length(whole) - 1)"), 3: F.concat(F.lit('{"mode":"x",'), F.substring(F.col("whole"), 2, 1 << 30)), 4: F.lit('{"items":[]}'), 5: F.lit('{"items":null}'),
        6: F.concat(F.lit('{"items":[{"id":"a","role":"user"},'), items, F.lit("]}")), 7: F.concat(F.lit('{"items":[{"id":7},'), items, F.lit("]}")), 8: F.lit('{"items":{"id":"a"}}'),
    }
    body = F.col("whole")
    for k, b in broken.items():
        body = F.when(kind == k, b).otherwise(body)
    return turns.withColumn("whole", whole).select("conv_id", body.alias("body"))


def _saves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vaults of the words of each first turn, their versions, a save for each later turn; every third read an old version)."""
    turns = _turns(spark, sf_dir).select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").cast("long").alias("save_id"), F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0)).alias("w"))
    words = F.filter("w", lambda w: F.length(w) >= 6)
    first = turns.where("save_id = 0").select("session_id", F.posexplode(F.array_distinct(words)).alias("i", "matched"))
    tokens = first.select("session_id", "matched", F.lit("default").alias("gen_key"), (F.col("i") + 1).alias("seq"))
    versions = turns.where("save_id = 0").select("session_id", F.lit(1).cast("long").alias("payload_version"))
    values = F.transform(words, lambda w: F.struct(w.alias("matched"), F.lit("passport").alias("pattern")))
    return tokens, versions, turns.where("save_id > 0").select("session_id", "save_id", F.when(F.col("save_id") % 3 == 1, 0).otherwise(1).cast("long").alias("base_version"), values.alias("values"))


def vault_saves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which concurrent saves are stored, at which try and version."""
    _, versions, saved = _saves(spark, sf_dir)
    return saves.judged(saved, versions).select("session_id", "save_id", "status", "tries", "payload_version")


def vault_saved_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vaults' numbers after those saves."""
    tokens, versions, saved = _saves(spark, sf_dir)
    return saves.folded(tokens, saves.judged(saved, versions))


def sealed_vaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vaults of the words of each first turn, sealed under several keys, some of them damaged: how each opens by a current key and
    an older one, and, with data keys wrapped anew, by the current key alone."""
    tokens, _, _ = _saves(spark, sf_dir)
    kind = F.col("session_id").cast("long") % 6
    rows = tokens.select("session_id", F.col("seq").alias("ord"), "matched", F.concat(F.lit("T"), F.col("seq").cast("string")).alias("token"), "gen_key", "seq")
    old, key, lost = (bytes([i]) * 32 for i in (1, 2, 3))
    both = sealed.StaticKeys("k2", key, {"k1": old})
    stored = (
        sealed.seal(rows.where(kind.isin(0, 4, 5)), sealed.StaticKeys("k1", old)).unionByName(sealed.seal(rows.where(kind == 1), both))
        .unionByName(sealed.seal(rows.where(kind == 2), sealed.StaticKeys("k0", lost))).unionByName(sealed.seal(rows.where(kind == 3), sealed.StaticKeys("k1", lost)))
    )
    damaged = stored.withColumns({
        "ciphertext": F.when(kind == 4, F.expr("concat(ciphertext, X'00')")).otherwise(F.col("ciphertext")), "schema_version": F.when(kind == 5, 9).otherwise(F.col("schema_version")),
    })
    values = F.from_json("state", "array<struct<matched:string,token:string>>")
    opened = lambda df, keys: sealed.unseal(df, keys).select("session_id", "status", F.size(values).alias("n"), F.element_at(values, -1)["matched"].alias("last"))
    now = opened(damaged, both).select("session_id", F.lit("both").alias("keys"), "status", F.when(F.col("status") == "ok", F.col("n")).alias("n_values"), "last")
    later = opened(sealed.rewrapped(damaged, both), sealed.StaticKeys("k2", key)).select("session_id", F.lit("current").alias("keys"), "status", F.when(F.col("status") == "ok", F.col("n")).alias("n_values"), "last")
    return now.unionByName(later)


LIMITS = requests.Limits(max_items=6, max_prompt_bytes=700)


def request_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status and reason of each conversation's request, and how many items it has."""
    read = requests.envelopes(_bodies(spark, sf_dir), limits=LIMITS)
    return read.select("conv_id", "status", "reason", F.coalesce(F.size("items"), F.lit(0)).alias("n_items"))


def request_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items of the requests that hold, with the first check that each fails."""
    items = requests.envelope_items(requests.envelopes(_bodies(spark, sf_dir), limits=LIMITS), "conv_id")
    return items.select("conv_id", "item_index", "id", "prompt", "session_id", "sanitization_mode", "slm", requests.item_error(LIMITS).alias("error_code"))


def request_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each conversation's request asks for: modes, and items for the model."""
    items = requests.envelope_items(requests.envelopes(_bodies(spark, sf_dir), limits=LIMITS), "conv_id")
    return items.groupBy("conv_id").agg(*requests.mode_aggregates())


#: A deployment's file, of which most values are defaults.
SETTINGS = """
proxy:
  behavior: {sanitization_mode: tokenize, max_prompt_bytes: 300}
  anthropic: {enabled: true, base_url: "https://a.example"}
  gemini: {enabled: true, base_url: "https://g.example"}
  model_routing: {default_provider: anthropic, models: {special: google}, prefixes: {claude-: anthropic, gemini-: gemini, gemini-2: anthropic}}
"""
ASKED = ["claude-3", "gemini-1", "gemini-2.5", "special", "other", " "]


def configured_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as items that ask for a model, under a deployment's settings: their provider, mode and first failed check."""
    s = settings.parsed(SETTINGS, {})
    asked = F.get(F.array(*map(F.lit, ASKED)), ((F.col("conv_id") + F.col("turn")) % len(ASKED)).cast("int"))
    items = _turns(spark, sf_dir).select("conv_id", "turn", asked.alias("model"), F.col("text").alias("prompt"), F.lit("").alias("session_id"), F.when(F.col("turn") == 2, "redact").when(F.col("turn") == 3, "mask").alias("sanitization_mode"))
    return s.route(items).select("conv_id", "turn", "provider", rewrite.resolved_mode(F.col("sanitization_mode"), s.behaviour.sanitization_mode).alias("mode"), requests.item_error(s.limits()).alias("error_code"))


STATUSES = ["ok", "unavailable", "unknown_key", "wrong_key", "corrupt", "conflict"]


def batch_store_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as items of their conversation's session, whose vault some stores can't give: the first error of each item."""
    h = F.md5(F.col("conv_id").cast("string"))
    session = F.concat(F.lit("vlt_"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]))
    turns = _turns(spark, sf_dir).withColumn("session_id", session)
    status = lambda n: F.get(F.array(*map(F.lit, STATUSES)), (n % len(STATUSES)).cast("int"))
    # Each turn's save has a status of its own in every seventh conversation; others have one status.
    stored = turns.where("conv_id % 3 <> 2").select("session_id", status(F.when(F.col("conv_id") % 7 == 0, F.col("conv_id") + F.col("turn")).otherwise(F.col("conv_id"))).alias("status"))
    items = turns.select("conv_id", "turn", F.col("text").alias("prompt"), F.when(F.col("turn") == 5, "bad").otherwise(F.col("session_id")).alias("session_id"), F.when(F.col("turn") % 3 == 1, "redact").alias("sanitization_mode"))
    return requests.checked_items(items, "tokenize", LIMITS, stored=stored).select("conv_id", "turn", "mode", "error_code")


def queries() -> dict:
    return {f.__name__: f for f in (batch_store_errors, configured_turns, vault_saves, vault_saved_numbers, sealed_vaults, request_envelopes, request_items, request_summary, vault_lifecycle, vault_epoch_numbers, streamed_vault_numbers, vault_replay, resolved_conversations, bioes_decode)}


_TIMES = f"t AS (SELECT conv_id, conv_id::VARCHAR AS s, turn AS o, conv_id * {START_S} + turn * turn * {GROWTH_S} AS tm FROM conversations)"
_DOC_TIMES = f"t AS (SELECT source AS s, doc_id AS o, doc_id * {STEP_S} + doc_id // 100 * {PAUSE_S} AS tm FROM documents WHERE source IS NOT NULL)"
_STREAM_TIMES = f"t AS (SELECT (doc_id // {SESSION_DOCS})::VARCHAR AS s, doc_id AS o, doc_id * {STEP_S} + doc_id // {EPOCH_DOCS} * {PAUSE_S} AS tm FROM documents)"
_EPOCHS = f"""
g AS (SELECT *, CASE WHEN tm - lag(tm) OVER (PARTITION BY s ORDER BY tm, o) >= {lifecycle.TTL_S} THEN 1 ELSE 0 END AS fresh FROM t),
e AS (SELECT *, sum(fresh) OVER (PARTITION BY s ORDER BY tm, o ROWS UNBOUNDED PRECEDING)::BIGINT AS epoch FROM g)"""


def _numbers_sql(times: str, requests: str) -> str:
    """How many values of each family a vault has. times: the requests' times; requests: their texts, as e's table x."""
    from .catalogue import _vault_ctes

    ctes = _vault_ctes()
    start = ctes.index("SELECT conv_id::VARCHAR AS session_id")
    end = ctes.index("UNION ALL", start)
    stop = ctes.index(")", ctes.index("AS v(s, o, t)", end) + len("AS v(s, o, t)"))
    turns = "SELECT s || '#' || epoch AS session_id, o AS request_order, coalesce(text, '') AS t FROM e JOIN " + requests
    numbers = (ctes[:start] + turns + ctes[stop:]).removeprefix("WITH ")
    return f"""WITH {times}, {_EPOCHS}, {numbers}
SELECT string_split(session_id, '#')[1] AS session_id, string_split(session_id, '#')[2]::BIGINT AS epoch, gen_key, count(*) AS n, min(seq) AS first, max(seq) AS last FROM numbers GROUP BY ALL"""


def oracle_sql() -> dict:
    room = "STRUCT(s VARCHAR, e BIGINT)[]"
    tags = "[" + ", ".join(f"'{t}'" for t in TAGS) + "]"
    sent = f"""n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id),
e AS (SELECT *, conv_id % 12 AS k, CASE WHEN k IN (1, 2, 7) THEN 'invalid JSON' WHEN k IN (3, 8) THEN 'unknown field' WHEN k IN (4, 5) THEN 'no items' WHEN n > {LIMITS.max_items} OR k IN (6, 7) AND n + 1 > {LIMITS.max_items} THEN 'too many items' WHEN k = 6 THEN 'unknown field' END AS reason FROM n),
f AS (SELECT conv_id, n, k, CASE WHEN k = 7 AND n + 1 > {LIMITS.max_items} THEN 'too many items' ELSE reason END AS reason FROM e),
i AS (SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS item_index, conv_id || '-' || turn AS id, coalesce(text, '') AS prompt, CASE turn WHEN 2 THEN 'vlt_no' WHEN 3 THEN 'vlt_{'0' * 36}' END AS session_id,
             CASE turn WHEN 4 THEN 'other' WHEN 5 THEN 'tokenize' END AS sanitization_mode, turn = 1 AS slm FROM conversations JOIN f USING (conv_id) WHERE reason IS NULL)"""
    # Round by round: of the pending saves that read the current version the first is stored, the others read the new one.
    rounds = rf"""t AS (SELECT conv_id::VARCHAR AS s, turn AS o, list_filter(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda w: length(w) >= 6) AS w FROM conversations),
p AS (
  SELECT s, 0 AS round, CASE WHEN bool_or(o = 0) THEN 1 ELSE 0 END::BIGINT AS version, list({{'o': o, 'b': CASE WHEN o % 3 = 1 THEN 0 ELSE 1 END}} ORDER BY o) FILTER (WHERE o > 0) AS pending, NULL::BIGINT AS won FROM t GROUP BY s
  UNION ALL
  SELECT s, round + 1, version + CASE WHEN w IS NULL THEN 0 ELSE 1 END, list_transform(list_filter(pending, lambda x: w IS NULL OR x.o <> w), lambda x: {{'o': x.o, 'b': (version + CASE WHEN w IS NULL THEN 0 ELSE 1 END)::INT}}), w
  FROM (SELECT *, list_min(list_transform(list_filter(pending, lambda x: x.b = version), lambda x: x.o)) AS w FROM p WHERE round < {saves.ATTEMPTS} AND len(pending) > 0)),
j AS (SELECT t.s, t.o, w, round, version FROM t LEFT JOIN p ON p.s = t.s AND p.won = t.o WHERE t.o > 0)"""
    return {
        "vault_saves": f"WITH RECURSIVE {rounds} SELECT s AS session_id, o AS save_id, CASE WHEN round IS NULL THEN 'conflict' ELSE 'saved' END AS status, coalesce(round, {saves.ATTEMPTS})::INT AS tries, version AS payload_version FROM j",
        "vault_saved_numbers": f"""WITH RECURSIVE {rounds},
a AS (SELECT s, 1::BIGINT AS version, NULL::BIGINT AS added, w FROM t WHERE o = 0 UNION ALL SELECT s, version, version, w FROM j WHERE round IS NOT NULL),
u AS (SELECT s, version, added, unnest(w) AS matched, generate_subscripts(w, 1) AS i FROM a),
f AS (SELECT s, matched, min((version, i)) AS ord, nullif(min(version), 1) AS added FROM u GROUP BY s, matched)
SELECT s AS session_id, matched, 'default' AS gen_key, row_number() OVER (PARTITION BY s ORDER BY ord) AS seq, added AS payload_version FROM f""",
        "batch_store_errors": f"""WITH s AS (SELECT conv_id, {STATUSES!r}[(CASE WHEN conv_id % 7 = 0 THEN conv_id + turn ELSE conv_id END) % {len(STATUSES)} + 1] AS status FROM conversations WHERE conv_id % 3 <> 2),
b AS (SELECT conv_id, CASE WHEN bool_or(status IN ('unknown_key', 'wrong_key', 'corrupt')) THEN 'sanitization_failed' WHEN bool_or(status IN ('unavailable', 'conflict')) THEN 'session_store_unavailable' END AS failed FROM s GROUP BY conv_id)
SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN 'redact' ELSE 'tokenize' END AS mode,
  CASE WHEN coalesce(text, '') = '' THEN 'missing_prompt' WHEN strlen(text) > {LIMITS.max_prompt_bytes} THEN 'prompt_too_large' WHEN turn = 5 THEN 'invalid_session_id' WHEN turn % 3 <> 1 THEN failed END AS error_code FROM conversations LEFT JOIN b USING (conv_id)""",
        "configured_turns": f"""SELECT conv_id, turn, CASE {ASKED!r}[(conv_id + turn) % {len(ASKED)} + 1] WHEN ' ' THEN NULL WHEN 'gemini-1' THEN 'gemini' WHEN 'special' THEN 'gemini' ELSE 'anthropic' END AS provider,
  CASE turn WHEN 2 THEN 'redact' WHEN 3 THEN 'mask' ELSE 'tokenize' END AS mode, CASE WHEN coalesce(text, '') = '' THEN 'missing_prompt' WHEN strlen(text) > 300 THEN 'prompt_too_large' WHEN turn = 3 THEN 'invalid_sanitization_mode' END AS error_code FROM conversations""",
        "sealed_vaults": r"""WITH t AS (SELECT conv_id, unnest(list_filter(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda w: length(w) >= 6)) AS w, generate_subscripts(list_filter(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda w: length(w) >= 6), 1) AS i FROM conversations WHERE turn = 0),
f AS (SELECT conv_id, w, min(i) AS i FROM t GROUP BY ALL),
v AS (SELECT conv_id, conv_id % 6 AS k, count(*)::INT AS n, arg_max(w, i) AS last FROM f GROUP BY conv_id),
s AS (SELECT *, unnest(['both', 'current']) AS keys FROM v)
SELECT conv_id::VARCHAR AS session_id, keys, CASE WHEN k < 2 THEN 'ok' WHEN k >= 4 THEN 'corrupt' WHEN k = 3 AND keys = 'both' THEN 'wrong_key' ELSE 'unknown_key' END AS status, CASE WHEN k < 2 THEN n END AS n_values, CASE WHEN k < 2 THEN last END AS last FROM s""",
        "request_envelopes": f"WITH {sent} SELECT conv_id, CASE WHEN reason IS NULL THEN 200 ELSE 400 END AS status, reason, CASE WHEN reason IS NULL THEN n ELSE 0 END::INT AS n_items FROM f",
        "request_items": f"WITH {sent} SELECT *, CASE WHEN prompt = '' THEN 'missing_prompt' WHEN strlen(prompt) > {LIMITS.max_prompt_bytes} THEN 'prompt_too_large' WHEN session_id = 'vlt_no' THEN 'invalid_session_id' WHEN sanitization_mode = 'other' THEN 'invalid_sanitization_mode' END AS error_code FROM i",
        "request_summary": f"WITH {sent} SELECT conv_id, count(*) FILTER (WHERE sanitization_mode = 'redact') AS redact, count(*) FILTER (WHERE sanitization_mode = 'tokenize') AS tokenize, count(*) FILTER (WHERE slm) AS slm FROM i GROUP BY conv_id",
        "vault_lifecycle": f"""WITH {_TIMES}, {_EPOCHS},
v AS (SELECT s, epoch, min(tm) AS a, max(tm) + {lifecycle.TTL_S} AS b, count(*) AS n FROM e GROUP BY ALL)
SELECT s AS session_id, epoch, a AS started_at, b AS expires_at, n AS requests, (SELECT count(*) FROM v x WHERE (x.a, x.s, x.epoch) <= (v.a, v.s, v.epoch) AND x.b > v.a)::BIGINT AS live FROM v""",
        "vault_epoch_numbers": _numbers_sql(_DOC_TIMES, "documents x ON x.source = e.s AND x.doc_id = e.o"),
        "streamed_vault_numbers": _numbers_sql(_STREAM_TIMES, "documents x ON x.doc_id = e.o"),
        "vault_replay": f"""WITH RECURSIVE {_TIMES},
c AS (SELECT (conv_id % {STORES})::VARCHAR AS store, s, o, tm, CASE WHEN (conv_id + o) % 11 = 10 THEN 'delete' WHEN (conv_id + o) % 5 = 4 THEN 'get' ELSE 'begin' END AS action,
             row_number() OVER (PARTITION BY conv_id % {STORES} ORDER BY tm, s, o) AS i FROM t),
p AS (
  SELECT DISTINCT store, 0::BIGINT AS i, NULL::VARCHAR AS s, NULL::BIGINT AS o, NULL::VARCHAR AS action, NULL::VARCHAR AS status, false AS made, []::{room} AS held FROM c
  UNION ALL
  SELECT store, i, s, o, action, status, made, CASE WHEN status = 'ok' AND action <> 'delete' THEN list_append(after, {{'s': s, 'e': tm + {lifecycle.TTL_S}}}) ELSE after END
  FROM (
    SELECT *, CASE WHEN action = 'delete' OR live THEN 'ok' WHEN action = 'get' THEN CASE WHEN gone THEN 'session_expired' ELSE 'vault_not_found' END WHEN len(after) >= {STORE_ROOM} THEN 'vault_full' ELSE 'ok' END AS status,
           action = 'begin' AND NOT live AND len(after) < {STORE_ROOM} AS made
    FROM (
      SELECT *, CASE WHEN action = 'begin' AND NOT live AND len(rest) >= {STORE_ROOM} THEN list_filter(rest, lambda x: x.e > tm) ELSE rest END AS after
      FROM (
        SELECT c.*, list_filter(p.held, lambda x: x.s <> c.s) AS rest, len(list_filter(p.held, lambda x: x.s = c.s AND x.e > c.tm)) > 0 AS live, len(list_filter(p.held, lambda x: x.s = c.s AND x.e <= c.tm)) > 0 AS gone
        FROM p JOIN c ON c.store = p.store AND c.i = p.i + 1)))),
n AS (SELECT *, sum(made::INT) OVER (PARTITION BY store, s ORDER BY i ROWS UNBOUNDED PRECEDING) - 1 AS number FROM p WHERE i > 0)
SELECT store, s AS session_id, o AS request_order, action, CASE WHEN status = 'ok' AND action <> 'delete' THEN number::BIGINT END AS epoch, status FROM n""",
        "resolved_conversations": rf"""WITH w AS (SELECT conv_id, unnest(list_filter(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda x: length(x) >= 4)) AS word FROM conversations WHERE turn = 0),
k AS (SELECT conv_id, word AS k FROM w UNION SELECT conv_id, substr(word, 1, 3) FROM w),
r AS (SELECT conv_id, string_agg(regexp_escape(k), '|' ORDER BY length(k) DESC, k) AS pattern FROM k GROUP BY conv_id)
SELECT conv_id::VARCHAR AS session_id, turn, CASE WHEN pattern IS NOT NULL THEN regexp_replace(text, '(' || pattern || ')', '<\1>', 'g') END AS resolved_text, CASE WHEN pattern IS NULL THEN 'vault_expired' ELSE 'success' END AS resolve_status FROM conversations LEFT JOIN r USING (conv_id)""",
        "bioes_decode": rf"""WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS m, regexp_split_to_array(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS gap FROM conversations),
w AS (SELECT *, unnest(range(0, len(m))) AS i FROM t),
h AS (SELECT conv_id, turn, t, i, m[i + 1] AS word, list_sum(list_transform(m[1:i], lambda x: length(x)))::BIGINT AS b, list_sum(list_transform(gap[1:i + 1], lambda x: length(x)))::BIGINT AS c, ('0x' || substr(md5(m[i + 1] || '|' || i), 1, 7))::BIGINT AS h FROM w),
k AS (SELECT conv_id, turn, t, i, coalesce(b, 0) + coalesce(c, 0) - CASE WHEN i > 0 AND h % 3 = 0 THEN 1 ELSE 0 END AS s, coalesce(b, 0) + coalesce(c, 0) + length(word) AS e, {tags}[h % {len(TAGS)} + 1] AS tag, (h % 97)::DOUBLE / 97 AS score FROM h WHERE h % 7 <> 0),
l AS (SELECT *, tag IN ('', 'O', 'O-other') AS outside, CASE WHEN contains(tag, '-') THEN tag[1] ELSE 'B' END AS prefix, CASE WHEN contains(tag, '-') THEN tag[3:] ELSE tag END AS label FROM k),
f AS (SELECT *, NOT outside AND coalesce(lag(NOT outside AND prefix NOT IN ('S', 'U', 'E', 'L')) OVER o, false) AND label = lag(label) OVER o AND prefix NOT IN ('B', 'S', 'U') AS goes_on FROM l WINDOW o AS (PARTITION BY conv_id, turn ORDER BY i)),
g AS (SELECT *, sum((NOT goes_on)::INT) OVER (PARTITION BY conv_id, turn ORDER BY i ROWS UNBOUNDED PRECEDING) AS island FROM f),
p AS (SELECT conv_id, turn, t, island, any_value(label) AS label, arg_min(s, i) AS s, arg_max(e, i) AS e, avg(score) AS score FROM g WHERE NOT outside GROUP BY conv_id, turn, t, island),
q AS (SELECT * REPLACE (s + length(substr(t, s + 1, e - s)) - length(ltrim(substr(t, s + 1, e - s), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS s) FROM p),
j AS (SELECT *, coalesce(label = lag(label) OVER o AND trim(substr(t, lag(e) OVER o + 1, s - lag(e) OVER o), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '', false) AS near FROM q WINDOW o AS (PARTITION BY conv_id, turn ORDER BY s, e)),
u AS (SELECT *, sum((NOT near)::INT) OVER (PARTITION BY conv_id, turn ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS grp FROM j),
x AS (SELECT conv_id, turn, t, any_value(label) AS label, min(s) AS s, max(e) AS e, list_reduce(list(score ORDER BY s, e), lambda a, b: (a + b) / 2) AS score FROM u GROUP BY conv_id, turn, t, grp)
SELECT conv_id, turn, label, substr(t, s + 1, e - s) AS text, strlen(substr(t, 1, s))::INT AS start, strlen(substr(t, 1, e))::INT AS "end", round(score * 1e6)::BIGINT AS score FROM x""",
    }
