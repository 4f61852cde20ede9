"""Queries over the driver's tables, by name, and the DuckDB SQL that states the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.checks import entropy
from palimpsest.operators import advanced, contextual, overlap, payload, providers, report, requests, rewrite, routing, secrets, vault
from palimpsest.operators.detect import detect, one_by_one, pattern_group, raw_spans
from palimpsest.operators.overlap import resolved
from palimpsest.operators.spans import let, pattern_spans
from palimpsest.sources.patterns import load, patterns_frame

from . import oracle, payloads, sessions
from .fixtures import BROKEN_URIS, EXACT, ITEMS, MODELS, TEXTS, sql_values

Query = Callable[[SparkSession, str], DataFrame]
#: Modes that documents ask for as items, by turns.
SENT_MODES = ["redact", "", "tokenize", "mask"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores, where a scan has fewer partitions than cores (one file of one row group is one task).

    Detection costs far more than moving a text. A scan of many files stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, t of the documents and the fixed texts."""
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("t"))
    return docs.unionAll(spark.createDataFrame(TEXTS, "id long, t string"))


def _rows(texts: DataFrame, spans: Column) -> DataFrame:
    found = one_by_one(texts.select("id", spans.alias("v")), "v", "id")
    return found.select("id", *[F.col(f"x.{c}").alias(c) for c in ("type", "severity", "pattern", "matched", "position", "end")])


def _of(make: Callable[[Column, dict], Column]) -> Query:
    return lambda spark, sf_dir: _rows(_documents(spark, sf_dir), make(F.col("t"), {p.name: p for p in load()}))


def _pattern(name: str) -> Query:
    return _of(lambda t, loaded: pattern_spans(t, loaded[name]))


def escaped_uri(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _documents(spark, sf_dir).unionAll(spark.createDataFrame(BROKEN_URIS, "id long, t string"))
    return _rows(texts, advanced.escaped_uris(F.col("t"), {p.name: p for p in load()}))


def _detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(_documents(spark, sf_dir), "t")


def overlap_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of the 24 patterns that stay."""
    texts = _documents(spark, sf_dir).select("id", pattern_group("t", load()).alias("v"))
    return one_by_one(texts.select("id", resolved(F.col("v")).alias("v")), "v", "id").select("id", "x.*")


def raw_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(_documents(spark, sf_dir), raw_spans(F.col("t"), sql="t"))


def violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return one_by_one(_detected(spark, sf_dir), "violations", "id").select("id", "x.*")


def redacted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rewrite.sanitize(_documents(spark, sf_dir), "t")
    return out.select("id", "sanitized_text", "redacted_count", F.size("violations").alias("n_violations"), "safe")


def _count_by(column: str) -> Query:
    return lambda spark, sf_dir: violations(spark, sf_dir).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def _count_by_document(column: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = detect(_table(spark, sf_dir, "documents").select(column, "text"))
        return docs.groupBy(column).agg(F.sum(F.size("violations")).cast("long").alias("n_violations"), F.count_if(F.size("violations") > 0).alias("n_documents"))

    return run


def pii_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans for a million characters of each language, rounded down."""
    docs = detect(_table(spark, sf_dir, "documents").select("lang", "text"))
    return docs.groupBy("lang").agg((F.sum(F.size("violations")).cast("long") * 1000000).alias("a"), F.sum(F.length("text")).alias("b")).select("lang", F.expr("a div b").alias("per_million"))


def safe_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detected(spark, sf_dir).groupBy((F.size("violations") == 0).alias("safe")).agg(F.count(F.lit(1)).alias("n"))


def redaction_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each replacement is written."""
    labels = _detected(spark, sf_dir).select("id", F.transform(rewrite.rewritten_spans(F.col("violations")), rewrite.replacement).alias("v"))
    return one_by_one(labels, "v", "id").groupBy(F.col("x").alias("label")).agg(F.count(F.lit(1)).alias("n"))


def type_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A summary is empty where nothing was found; a filter by the violations' number would compute the violations twice.
    counted = _detected(spark, sf_dir).select("id", F.array(report.type_counts(F.col("violations"))).alias("v"))
    return one_by_one(counted, "v", "id").where("x <> ''").select("id", F.col("x").alias("summary"))


def entropy_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy of the texts in thousandths, rounded."""
    return _documents(spark, sf_dir).where("t <> ''").select("id", F.round(entropy(F.col("t")) * 1000).cast("long").alias("millibits"))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations and one session of the fixed texts as requests."""
    turns = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").cast("long").alias("request_order"), "text")
    fixed = spark.createDataFrame([("fixed", -i, t) for i, t in TEXTS] + [("fixed", 100, TEXTS[10][1]), ("fixed", 101, "again " + TEXTS[6][1])], "session_id string, request_order long, text string")
    return turns.unionAll(fixed)


def vault_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and tokens of every session's values."""
    _, tokens = vault.tokenize(_requests(spark, sf_dir))
    return tokens.select("session_id", "matched", "pattern", "gen_key", F.col("seq").cast("long").alias("seq"))


def numeric_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, tokens = vault.tokenize(_requests(spark, sf_dir))
    return tokens.where("gen_key = 'numeric'").select("session_id", "matched", "token")


def tokenized_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = vault.tokenize(_requests(spark, sf_dir))
    return out.select("session_id", "request_order", "sanitized_text", "redacted_count", "tokenized_count", "error")


def resolved_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each request resolves to its text with what detection matched; texts with credentials stay redacted. Fragments of
    e-mail tokens resolve too, so a text that holds such a fragment by itself is not the same."""
    requests_ = _requests(spark, sf_dir)
    out, tokens = vault.tokenize(requests_)
    back = vault.resolve(out.where("error IS NULL").select("session_id", "request_order", F.col("sanitized_text").alias("body"), "violations", "text"), vault.reverse_map(tokens, vault.vault_subtokens(tokens)))
    spans = rewrite.rewritten_spans(F.col("violations"))
    plain = rewrite.spliced(F.coalesce("text", F.lit("")), spans, F.transform(spans, lambda x: F.when(x["type"] == "credential", rewrite.label(x)).otherwise(x["matched"])))
    return back.where("resolve_status = 'success'").select("session_id", "request_order", (F.col("resolved_text") == plain).alias("same"))


def _items(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ITEMS, requests.ITEM)


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def _picked(values: list[str], number: Column) -> Column:
    """One of a list by number, round and round."""
    return F.get(F.array(*map(F.lit, values)), (number % len(values)).cast("int"))


def _all_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixed items and an item for each turn of the conversations, some of them wrong."""
    turn = F.col("turn")
    sent = _turns(spark, sf_dir).select(
        (1000 + F.col("conv_id") * 100 + turn).cast("int").alias("item_index"), F.col("conv_id").cast("string").alias("id"), F.when(turn != 6, F.col("text")).alias("prompt"),
        F.when(turn == 2, "bad").when(turn == 3, f"vlt_{'a' * 36}").alias("session_id"), _picked(["redact", "", "tokenize", "mask"], F.col("conv_id") + turn).alias("sanitization_mode"), (turn == 1).alias("slm"),
    )
    return _items(spark).unionAll(sent)


def batch_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all_items(spark, sf_dir).select("item_index", requests.item_error().alias("error_code"))


def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixed items and every document as one batch, in both modes, some of the items wrong."""
    i = F.col("doc_id")
    sent = _table(spark, sf_dir, "documents").select((i + len(ITEMS)).cast("long").alias("item_index"), i.cast("string").alias("id"), F.col("text").alias("prompt"), F.when(i % 7 == 3, "bad").alias("session_id"), _picked(SENT_MODES, i).alias("sanitization_mode"), F.lit(False).alias("slm"))
    items = _items(spark)
    return requests.summary(requests.run_batch(items.withColumn("item_index", F.col("item_index").cast("long")).unionByName(sent)))


def mode_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.mode_counts(_all_items(spark, sf_dir))


def route_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model for each turn: how many turns each model has, and where it goes."""
    exact, prefixes = routing.routes(spark, EXACT)
    model = F.concat(_picked(MODELS, F.col("conv_id")), F.when(F.col("turn") % 2 == 1, F.concat(F.lit("-"), F.col("turn").cast("string"))).otherwise(""))
    asked = _turns(spark, sf_dir).select(model.alias("model")).unionAll(spark.createDataFrame([(m,) for m in MODELS], "model string"))
    return routing.route(asked, exact, prefixes).groupBy("model", "provider").agg(F.count(F.lit(1)).alias("n"))


def capability_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A provider, route and stream flag for each turn: what is supported, and how often it is asked for."""
    fixed = spark.createDataFrame([(p, r, s) for p in providers.PROVIDERS for r in ("chat", "responses") for s in (False, True)], "provider string, route string, stream boolean")
    asked = _turns(spark, sf_dir).select(_picked([*providers.PROVIDERS, "other"], F.col("conv_id")).alias("provider"), _picked(["chat", "responses", "odd"], F.col("turn")).alias("route"), ((F.col("conv_id") + F.col("turn")) % 2 == 0).alias("stream"))
    return routing.check_capability(fixed.unionAll(asked), routing.capabilities(spark)).groupBy("provider", "route", "stream", "supported").agg(F.count(F.lit(1)).alias("n"))


def label_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of one model span for each turn with a text; one label in so many is unknown."""
    labels = [*contextual.LABELS, "unheard_of"]
    turns = _turns(spark, sf_dir).where("text <> ''")
    one = F.struct(_picked(labels, F.col("conv_id") + F.col("turn")).alias("label"), F.substring("text", 1, 1).alias("text"), F.lit(0).alias("start"), F.octet_length(F.substring("text", 1, 1)).alias("end"), F.lit(0.5).alias("score"))
    spans = turns.select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.array(one).cast(f"array<{contextual.MODEL_SPAN}>").alias("s"))
    return spans.select("id", F.explode(contextual.model_violations(F.col("s"))).alias("x")).select("id", "x.*")


def pages_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = detect(_table(spark, sf_dir, "pages").select("page_id", "html"), "html")
    return pages.select("page_id", F.size("violations").alias("n_violations"), report.type_counts(F.col("violations")).alias("summary"))


def quality_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of labelled documents by label."""
    found = detect(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.size("violations").alias("n"))
    return found.join(_table(spark, sf_dir, "labels"), "doc_id").groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n").cast("long").alias("n_violations"))


def diff_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rewrite.sanitize(_documents(spark, sf_dir), "t")
    v = F.col("violations")
    return out.select("id", report.diff_text(F.col("t"), F.col("sanitized_text"), F.size(report.changes(v))).alias("diff"), report.violation_list(v).alias("list"), report.summary_text(F.col("t"), F.col("sanitized_text"), v, F.lit(0.0)).alias("summary"))


def redacted_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as chat payloads, redacted as payloads."""
    turns = _table(spark, sf_dir, "conversations")
    chats = turns.groupBy("conv_id").agg(F.to_json(F.struct(F.lit("gpt-4o").alias("model"), F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content"))).alias("messages"))).alias("body"))
    return payload.rewrite_payloads(chats, "conv_id", "body", "chat", lambda rows: rewrite.sanitize(rows)).select("conv_id", "sanitized_body")


def default_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The patterns in their order, and how many violations of each the documents have."""
    used = one_by_one(_detected(spark, sf_dir), "violations").groupBy(F.col("x.pattern").alias("name")).agg(F.count(F.lit(1)).alias("n_violations"))
    named = patterns_frame(spark, load()).join(used, "name", "left")
    return named.select("load_order", "name", "type", "severity", F.coalesce("n_violations", F.lit(0)).alias("n_violations"))


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.metrics_text(rewrite.sanitize(_documents(spark, sf_dir), "t"))


def redacted_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages' URLs whose query holds no sensitive value."""
    query = F.regexp_extract("url", r"\?([^#]*)", 1)
    return _table(spark, sf_dir, "pages").where(F.contains("url", F.lit("?"))).select("page_id", report.redacted_query(query).alias("query"))


#: Candidate detectors by the name of their query: (Spark, SQL).
CANDIDATES = {
    "luhn_cards": (advanced.separated_cards, oracle.cards),
    "iban_mod97": (advanced.canonical_ibans, oracle.ibans),
    "phone_country": (advanced.phones, oracle.phones),
    "split_email": (advanced.split_emails, oracle.split_emails),
    "password_keys": (advanced.password_assignments, oracle.passwords),
    "base64_secret": (lambda t, _: advanced.base64_secrets(t), oracle.base64_runs),
    "canonical_email": (advanced.canonical_emails, oracle.canonical_emails),
    "aws_secret": (lambda t, _: secrets.aws_spans(t), oracle.aws),
}


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {f"spans_{p.name}": _pattern(p.name) for p in load()}
    found |= {name: _of(make) for name, (make, _) in CANDIDATES.items()}
    found["generic_secret"] = _of(lambda t, _: let(secrets.aws_spans(t), lambda aws: secrets.generic_spans(t, aws)))
    found["escaped_uri"] = escaped_uri
    found |= {f"violations_by_{c}": _count_by(c) for c in ("pattern", "type", "severity")}
    found |= {f"violations_by_{c}": _count_by_document(c) for c in ("lang", "source")}
    for f in (
        overlap_resolved, raw_violations, violations, redacted_documents, pii_density, safe_flag, redaction_labels, type_summary, entropy_values,
        vault_tokens, numeric_tokens, tokenized_conversations, resolved_roundtrip, batch_validation, batch_summary, mode_counts, route_models,
        capability_check, label_mapping, pages_pii, quality_join, diff_reports, redacted_payloads, default_patterns, metrics, redacted_urls,
    ):
        found[f.__name__] = f
    return found | sessions.queries() | payloads.queries()


_SPAN = 'id, type, severity, pattern, matched, position, "end"'


def _candidate_sql(rows: str, before: str = "") -> str:
    return f"""WITH src AS ({oracle.texts()}){before}
SELECT id, type, severity, pattern, matched, strlen(substr(t, 1, cs))::INT AS position, strlen(substr(t, 1, ce))::INT AS "end" FROM ({rows})"""


def _vault_ctes() -> str:
    """Detection over requests instead of documents, and every session's numbers."""
    fixed = [("fixed", -i, t) for i, t in TEXTS] + [("fixed", 100, TEXTS[10][1]), ("fixed", 101, "again " + TEXTS[6][1])]
    base = f"""req AS (SELECT row_number() OVER () AS id, session_id, request_order, t FROM (SELECT conv_id::VARCHAR AS session_id, turn AS request_order, coalesce(text, '') AS t FROM conversations UNION ALL SELECT * FROM {sql_values(fixed)} AS v(s, o, t))),
src AS (SELECT id, t FROM req),"""
    found = oracle.detection().replace(f"WITH src AS ({oracle.texts()}),", "WITH " + base, 1)
    from palimpsest.operators.tokens import FAMILIES

    family = "CASE " + " ".join(f"WHEN pattern = '{k}' THEN '{v}'" for k, v in FAMILIES.items()) + " WHEN ends_with(pattern, '_phone') THEN 'phone' ELSE 'default' END"
    return found + f""",
seen AS (SELECT session_id, matched, pattern, request_order AS a, -position AS b FROM kept JOIN req USING (id) WHERE severity IN ('BLOCK', 'WARN') AND type <> 'credential'),
firsts AS (SELECT session_id, matched, arg_min(pattern, (a, b)) AS pattern, min((a, b)) AS ord FROM seen GROUP BY ALL),
numbers AS (SELECT *, row_number() OVER (PARTITION BY session_id, gen_key ORDER BY ord, matched) AS seq FROM (SELECT *, {family} AS gen_key FROM firsts))"""


def oracle_sql() -> dict[str, str]:
    found = {f"spans_{p.name}": _candidate_sql(oracle.of_pattern(p)) for p in load()}
    found |= {name: _candidate_sql(sql()) for name, (_, sql) in CANDIDATES.items()}
    found["generic_secret"] = _candidate_sql(oracle.generic(), f", aws AS ({oracle.aws()})")
    broken = f"{oracle.texts()} UNION ALL SELECT * FROM {sql_values(BROKEN_URIS)} AS b(id, t)"
    found["escaped_uri"] = _candidate_sql("SELECT * FROM uris", oracle.escaped_uris()).replace(oracle.texts(), broken, 1)
    every = oracle.detection()
    red = oracle.redaction()
    by_doc = lambda c: f"{every}, n AS (SELECT id, count(*) AS n FROM kept GROUP BY id) SELECT {c}, coalesce(sum(n), 0)::BIGINT AS n_violations, count(n)::BIGINT AS n_documents FROM documents LEFT JOIN n ON doc_id = id GROUP BY {c}"
    found |= {f"violations_by_{c}": f"{every} SELECT {c}, count(*)::BIGINT AS n FROM kept GROUP BY {c}" for c in ("pattern", "type", "severity")}
    found |= {f"violations_by_{c}": by_doc(c) for c in ("lang", "source")}
    label = red.split("new FROM kept")[0].rsplit("prev, ", 1)[1].rsplit(" AS", 1)[0]
    pick = lambda values, n: f"[{', '.join(repr(v) for v in values)}][({n}) % {len(values)} + 1]"
    items = f"""(SELECT * FROM {sql_values(ITEMS)} UNION ALL SELECT 1000 + conv_id * 100 + turn, conv_id::VARCHAR, CASE WHEN turn <> 6 THEN text END, CASE turn WHEN 2 THEN 'bad' WHEN 3 THEN 'vlt_{'a' * 36}' END, {pick(["redact", "", "tokenize", "mask"], "conv_id + turn")}, turn = 1 FROM conversations)"""
    capable = sql_values(list(routing.CAPABILITIES))
    models = f"(SELECT * FROM {sql_values([(m,) for m in MODELS])} UNION ALL SELECT {pick(MODELS, 'conv_id')} || CASE WHEN turn % 2 = 1 THEN '-' || turn ELSE '' END FROM conversations)"
    found |= {
        "overlap_resolved": f"{oracle.detection(everything=False)} SELECT {_SPAN} FROM kept",
        "raw_violations": f"{every} SELECT {_SPAN} FROM raw",
        "violations": f"{every} SELECT {_SPAN} FROM kept",
        "redacted_documents": f"{red} SELECT *, n_violations = 0 AS safe FROM red",
        "pii_density": f"{every}, n AS (SELECT id, count(*) AS n FROM kept GROUP BY id) SELECT lang, (coalesce(sum(n), 0)::BIGINT * 1000000) // sum(length(text))::BIGINT AS per_million FROM documents LEFT JOIN n ON doc_id = id GROUP BY lang",
        "safe_flag": f"{red} SELECT n_violations = 0 AS safe, count(*)::BIGINT AS n FROM red GROUP BY 1",
        "redaction_labels": f"{every} SELECT {label} AS label, count(*)::BIGINT AS n FROM kept WHERE severity IN ('BLOCK', 'WARN') GROUP BY 1",
        "type_summary": f"{every} SELECT id, string_agg(type || ':' || n, ',' ORDER BY type || ':' || n) AS summary FROM (SELECT id, type, count(*) AS n FROM kept GROUP BY ALL) GROUP BY id",
        "entropy_values": f"SELECT id, round(-list_sum(list_transform(list_distinct(string_split(t, '')), lambda c: (length(t) - length(replace(t, c, ''))) / length(t) * log2((length(t) - length(replace(t, c, ''))) / length(t)))) * 1000)::BIGINT AS millibits FROM ({oracle.texts()}) WHERE t <> ''",
        "vault_tokens": f"{_vault_ctes()} SELECT session_id, matched, pattern, gen_key, seq FROM numbers",
        "numeric_tokens": f"{_vault_ctes()} SELECT session_id, matched, lpad(seq::VARCHAR, strlen(matched)::INT, '0') AS token FROM numbers WHERE gen_key = 'numeric'",
        "batch_validation": f"SELECT i::INT AS item_index, CASE WHEN coalesce(p, '') = '' THEN 'missing_prompt' WHEN strlen(p) > 65536 THEN 'prompt_too_large' WHEN coalesce(s, '') <> '' AND NOT regexp_full_match(s, 'vlt_[0-9a-fA-F-]{{36}}') THEN 'invalid_session_id' WHEN coalesce(m, '') <> '' AND m NOT IN ('redact', 'tokenize') THEN 'invalid_sanitization_mode' END AS error_code FROM {items} AS v(i, id, p, s, m, slm)",
        # The fixed items: seven, of which three hold, with two violations that are redacted.
        "batch_summary": f"""{every}, v AS (SELECT id, count(*) AS n, count(*) FILTER (WHERE severity IN ('BLOCK', 'WARN')) AS r, count(*) FILTER (WHERE severity IN ('BLOCK', 'WARN') AND type <> 'credential') AS t FROM kept GROUP BY id),
i AS (SELECT doc_id, {pick(SENT_MODES, "doc_id")} AS m, coalesce(text, '') <> '' AND strlen(text) <= 65536 AND doc_id % 7 <> 3 AND m <> 'mask' AS ok FROM documents)
SELECT count(*) + 7 AS total, count(*) FILTER (WHERE ok) + 3 AS succeeded, count(*) FILTER (WHERE NOT ok) + 4 AS failed, (coalesce(sum(n) FILTER (WHERE ok), 0) + 2)::BIGINT AS violations, (coalesce(sum(r) FILTER (WHERE ok), 0) + 2)::BIGINT AS redacted, coalesce(sum(t) FILTER (WHERE ok AND m = 'tokenize'), 0)::BIGINT AS tokenized FROM i LEFT JOIN v ON id = doc_id""",
        "mode_counts": f"SELECT count(*) FILTER (WHERE m = 'redact') AS redact, count(*) FILTER (WHERE m = 'tokenize') AS tokenize, count(*) FILTER (WHERE slm) AS slm FROM {items} AS v(i, id, p, s, m, slm)",
        "route_models": f"SELECT model, provider, count(*) AS n FROM (SELECT model, CASE WHEN trim(model) = '' THEN NULL ELSE coalesce((SELECT p FROM {sql_values(list(EXACT.items()))} AS e(n, p) WHERE n = model), (SELECT arg_max(p, length(n)) FROM {sql_values(list(routing.PREFIXES))} AS x(n, p) WHERE starts_with(model, n)), 'openai') END AS provider FROM {models} AS m(model)) GROUP BY ALL",
        "capability_check": f"""WITH q AS (
SELECT p AS provider, route, stream FROM {capable} AS v(p, c, cs, r, rs), (VALUES ('chat'), ('responses')) AS a(route), (VALUES (false), (true)) AS b(stream)
UNION ALL SELECT {pick([*providers.PROVIDERS, "other"], "conv_id")}, {pick(["chat", "responses", "odd"], "turn")}, (conv_id + turn) % 2 = 0 FROM conversations)
SELECT provider, route, stream, coalesce(CASE route WHEN 'chat' THEN CASE WHEN stream THEN cs ELSE c END WHEN 'responses' THEN CASE WHEN stream THEN rs ELSE r END END, false) AS supported, count(*) AS n FROM q LEFT JOIN {capable} AS v(p, c, cs, r, rs) ON p = provider GROUP BY ALL""",
        "label_mapping": f"""SELECT conv_id * 100 + turn AS id, type, severity, pattern, text[1] AS matched, 0::INT AS position, strlen(text[1])::INT AS "end"
FROM conversations JOIN {sql_values([(n, *contextual.LABELS[n]) for n in contextual.LABELS])} AS v(n, type, severity, pattern) ON n = {pick([*contextual.LABELS, "unheard_of"], "conv_id + turn")} WHERE text <> ''""",
        "pages_pii": oracle.detection().replace(oracle.texts(), "SELECT page_id AS id, coalesce(html, '') AS t FROM pages", 1) + " SELECT page_id, coalesce(sum(n), 0)::INT AS n_violations, coalesce(string_agg(type || ':' || n, ',' ORDER BY type || ':' || n), '') AS summary FROM pages LEFT JOIN (SELECT id, type, count(*) AS n FROM kept GROUP BY ALL) ON page_id = id GROUP BY page_id",
        "quality_join": f"{every}, n AS (SELECT id, count(*) AS n FROM kept GROUP BY id) SELECT quality, toxic, count(*)::BIGINT AS n_documents, coalesce(sum(n), 0)::BIGINT AS n_violations FROM labels JOIN documents USING (doc_id) LEFT JOIN n ON id = doc_id GROUP BY ALL",
        "redacted_payloads": oracle.redaction().replace(oracle.texts(), "SELECT conv_id * 1000 + turn AS id, coalesce(text, '') AS t FROM conversations", 1) + """
SELECT conv_id, '{"model":"gpt-4o","messages":[' || string_agg('{"role":"' || role || '"' || CASE WHEN text IS NULL THEN '' ELSE ',"content":' || to_json(sanitized_text)::VARCHAR END || '}', ',' ORDER BY turn) || ']}' AS sanitized_body FROM conversations JOIN red ON red.id = conv_id * 1000 + turn GROUP BY conv_id""",
        "default_patterns": f"""{every}, n AS (SELECT pattern, count(*) AS n FROM kept GROUP BY pattern)
SELECT i::INT AS load_order, name, type, severity, coalesce(n, 0)::BIGINT AS n_violations FROM {sql_values([(i, p.name, p.type, p.severity) for i, p in enumerate(load())])} AS v(i, name, type, severity) LEFT JOIN n ON pattern = name""",
        "metrics": f"{red} SELECT '# TYPE sanitizer_requests_total counter' || chr(10) || 'sanitizer_requests_total ' || count(*) || chr(10) || '# TYPE sanitizer_violations_total counter' || chr(10) || 'sanitizer_violations_total ' || sum(n_violations) || chr(10) || '# TYPE sanitizer_redacted_total counter' || chr(10) || 'sanitizer_redacted_total ' || sum(redacted_count) || chr(10) || '# TYPE sanitizer_safe_total counter' || chr(10) || 'sanitizer_safe_total ' || count(*) FILTER (WHERE n_violations = 0) || chr(10) AS text FROM red",
        "redacted_urls": "SELECT page_id, array_to_string(list_sort(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&')), '&') AS query FROM pages WHERE contains(url, '?')",
    }
    return found | sessions.oracle_sql() | payloads.oracle_sql()
