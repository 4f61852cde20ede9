"""Queries of payloads over the conversations: their texts, their translations for each provider, and providers' answers.

A conversation is one chat payload and one responses payload; what is odd about them goes by its id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import payload, providers

KINDS = 8


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, route, body."""
    k, text, turn = F.col("conv_id") % KINDS, F.col("text"), F.col("turn")
    when = lambda n, c, of=None: F.when((k == n) if of is None else (k == n) & (turn == of), c)
    call = F.array(F.struct(F.struct(F.lit("f").alias("name"), text.alias("arguments")).alias("function")))
    chat = F.struct(F.coalesce(when(3, "tool", 1), F.col("role")).alias("role"), F.when((k != 6) | (turn != 1), text).alias("content"), when(5, "n", 0).alias("name"), when(6, call, 1).alias("tool_calls"))
    block = F.struct(F.coalesce(when(3, "image", 1), F.lit("input_text")).alias("type"), text.alias("text"))
    more = F.struct(F.lit("input_text").alias("type"), F.lit("more").alias("text"))
    sent = F.struct(F.when((k != 5) | (turn % 2 == 0), F.coalesce(when(7, "tool", 1), F.col("role"))).alias("role"), F.when(k == 6, F.array(block, more)).otherwise(F.array(block)).alias("content"))
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", F.struct("turn", F.coalesce(text, F.lit("")).alias("text"), chat.alias("chat"), sent.alias("sent")).alias("x"))
    convs = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    first, last = F.element_at("xs", 1)["text"], F.element_at("xs", -1)["text"]
    tools = F.array(F.struct(F.struct(first.alias("description"), F.struct(F.struct(last.alias("description")).alias("x")).alias("parameters")).alias("function")))
    settings = [F.lit("m").alias("model"), when(1, 1).alias("seed"), when(4, 0.5).alias("temperature")]
    chats = F.to_json(F.struct(*settings, F.transform("xs", lambda x: x["chat"]).alias("messages"), when(4, 7).alias("max_tokens"), when(2, tools).alias("tools")))
    common = [F.lit("m").alias("model"), when(1, F.lit(True)).alias("stream"), when(2, last).alias("instructions"), when(4, 7).alias("max_output_tokens"), when(4, 0.5).alias("top_p")]
    asked = F.when(k == 0, F.to_json(F.struct(*common, first.alias("input")))).otherwise(F.to_json(F.struct(*common, F.transform("xs", lambda x: x["sent"]).alias("input"))))
    both = F.array(F.struct(F.lit("chat").alias("route"), chats.alias("body")), F.struct(F.lit("responses").alias("route"), asked.alias("body")))
    return convs.select("conv_id", F.explode(both).alias("p")).select("conv_id", "p.*")


def _by_route(make, *columns: Column) -> Column:
    return F.when(F.col("route") == "chat", make(*columns, "chat")).otherwise(make(*columns, "responses"))


def payload_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of each payload in the order in which a proxy reads them."""
    found = _payloads(spark, sf_dir).select("conv_id", "route", F.posexplode(_by_route(payload.texts_of, F.col("body"))).alias("ord", "t"))
    return found.select("conv_id", "route", "ord", "t.path", "t.text")


def provider_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each payload's request for each provider, or why there is none."""
    asked = _payloads(spark, sf_dir).withColumn("provider", F.explode(F.array(*map(F.lit, [*providers.PROVIDERS, "other"]))))
    made = asked.withColumn("r", _by_route(providers.provider_request, F.col("body"), F.col("provider")))
    return made.select("conv_id", "route", "provider", "r.request", "r.error")


def provider_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as providers' answers: their text, and the answer in the shape of either route."""
    text = F.when(F.col("turn") != 6, F.col("text"))
    kind = (F.col("conv_id") + F.col("turn")) % 4
    part = lambda t: F.struct(F.lit("text").alias("type"), t.alias("text"))
    anthropic = F.to_json(F.struct(F.when(text.isNotNull(), F.array(part(text), F.struct(F.lit("tool_use").alias("type"), F.lit("no").alias("text")), part(F.lit("end")))).otherwise(F.array()).alias("content")))
    gemini = F.to_json(F.struct(F.array(F.struct(F.struct(F.array(F.struct(text.alias("text")), F.struct(F.lit("").alias("text"))).alias("parts")).alias("content"))).alias("candidates")))
    other = F.to_json(F.struct(F.array(F.struct(F.struct(text.alias("content")).alias("message"))).alias("choices")))
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", F.get(F.array(*map(F.lit, providers.PROVIDERS)), kind.cast("int")).alias("provider"), F.when(kind == 0, anthropic).when(kind == 1, gemini).otherwise(other).alias("body"))
    read = turns.withColumn("text", providers.answer_text(F.col("body"), F.col("provider")))
    shaped = lambda route: providers.normal_answer(F.col("text"), F.lit("m"), route, F.col("conv_id").cast("string"), F.col("turn"))
    return read.select("conv_id", "turn", "provider", "text", shaped("chat").alias("chat"), shaped("responses").alias("responses"))


def queries() -> dict:
    return {f.__name__: f for f in (payload_texts, provider_requests, provider_answers)}


def oracle_sql() -> dict:
    """The payloads are never built here: texts and requests follow from the turns. JSON texts have their fields sorted by name."""
    ctes = f"""t AS (SELECT conv_id, conv_id % {KINDS} AS k, turn, role, text, coalesce(text, '') AS full_text, to_json(coalesce(text, ''))::VARCHAR AS j, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i,
  first_value(coalesce(text, '')) OVER w AS head, last_value(coalesce(text, '')) OVER w AS tail FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""
    texts = f"""WITH {ctes},
a AS (
  SELECT conv_id, 'chat' AS route, i AS o, '/messages/' || i || CASE WHEN k = 6 AND turn = 1 THEN '/tool_calls/0/function/arguments' ELSE '/content' END AS path, text FROM t WHERE text IS NOT NULL
  UNION ALL SELECT conv_id, 'chat', 1000000, '/tools/0/function/description', head FROM t WHERE k = 2 AND i = 0
  UNION ALL SELECT conv_id, 'chat', 1000001, '/tools/0/function/parameters/x/description', tail FROM t WHERE k = 2 AND i = 0
  UNION ALL SELECT conv_id, 'responses', 0, '/input', head FROM t WHERE k = 0 AND i = 0
  UNION ALL SELECT conv_id, 'responses', 2 * i, '/input/' || i || '/content/0/text', text FROM t WHERE k <> 0 AND NOT (k = 3 AND turn = 1) AND text IS NOT NULL
  UNION ALL SELECT conv_id, 'responses', 2 * i + 1, '/input/' || i || '/content/1/text', 'more' FROM t WHERE k = 6
  UNION ALL SELECT conv_id, 'responses', 1000000, '/instructions', tail FROM t WHERE k = 2 AND i = 0)
SELECT conv_id, route, (row_number() OVER (PARTITION BY conv_id, route ORDER BY o) - 1)::INT AS ord, path, text FROM a"""
    requests = f"""WITH {ctes},
c AS (SELECT conv_id, any_value(k) AS k, bool_or(turn = 1) AS second, bool_or(turn = 0) AS opens, bool_or(text IS NULL AND k <> 0) AS hollow, any_value(to_json(head)::VARCHAR) AS head, any_value(to_json(tail)::VARCHAR) AS tail,
  string_agg('{{' || CASE WHEN text IS NULL OR k = 6 AND turn = 1 THEN '' ELSE '"content":' || j || ',' END || CASE WHEN k = 5 AND turn = 0 THEN '"name":"n",' ELSE '' END || '"role":"' || CASE WHEN k = 3 AND turn = 1 THEN 'tool' ELSE role END || '"' || CASE WHEN k = 6 AND turn = 1 THEN ',"tool_calls":[{{"function":{{"arguments":' || j || ',"name":"f"}}}}]' ELSE '' END || '}}', ',' ORDER BY turn) AS chat,
  string_agg('{{"content":[{{' || CASE WHEN text IS NULL THEN '' ELSE '"text":' || j || ',' END || '"type":"' || CASE WHEN k = 3 AND turn = 1 THEN 'image' ELSE 'input_text' END || '"}}' || CASE WHEN k = 6 THEN ',{{"text":"more","type":"input_text"}}' ELSE '' END || ']' || CASE WHEN k = 5 AND turn % 2 = 1 THEN '' ELSE ',"role":"' || CASE WHEN k = 7 AND turn = 1 THEN 'tool' ELSE role END || '"' END || '}}', ',' ORDER BY turn) AS sent
  FROM t GROUP BY conv_id),
m AS (
  SELECT conv_id, 'chat' AS route, i, role, full_text AS x FROM t
  UNION ALL SELECT conv_id, 'responses', i, CASE WHEN k = 5 AND turn % 2 = 1 THEN 'user' ELSE role END, CASE WHEN k = 6 THEN full_text || chr(10) || 'more' ELSE full_text END FROM t WHERE k <> 0
  UNION ALL SELECT conv_id, 'responses', 0, 'user', head FROM t WHERE k = 0 AND i = 0),
n AS (SELECT conv_id, route,
  coalesce(string_agg('{{"content":[{{"text":' || to_json(x)::VARCHAR || ',"type":"text"}}],"role":"' || role || '"}}', ',' ORDER BY i) FILTER (WHERE role <> 'system'), '') AS claude,
  coalesce(string_agg('{{"parts":[{{"text":' || to_json(x)::VARCHAR || '}}],"role":"' || CASE role WHEN 'assistant' THEN 'model' ELSE 'user' END || '"}}', ',' ORDER BY i) FILTER (WHERE role <> 'system'), '') AS google,
  string_agg('{{"content":' || to_json(x)::VARCHAR || ',"role":"' || role || '"}}', ',' ORDER BY i) AS deep,
  to_json(string_agg(x, chr(10) ORDER BY i) FILTER (WHERE role = 'system' AND x <> ''))::VARCHAR AS sys, string_agg('{{"text":' || to_json(x)::VARCHAR || '}}', ',' ORDER BY i) FILTER (WHERE role = 'system' AND x <> '') AS sysparts
  FROM m GROUP BY ALL),
b AS (
  SELECT conv_id, route, k, claude, google, deep, sys, sysparts, second, opens, hollow,
    CASE route WHEN 'chat' THEN '{{' || CASE WHEN k = 4 THEN '"max_tokens":7,' ELSE '' END || '"messages":[' || chat || '],"model":"m"' || CASE WHEN k = 1 THEN ',"seed":1' ELSE '' END || CASE WHEN k = 4 THEN ',"temperature":0.5' ELSE '' END
      || CASE WHEN k = 2 THEN ',"tools":[{{"function":{{"description":' || head || ',"parameters":{{"x":{{"description":' || tail || '}}}}}}}}]' ELSE '' END || '}}'
    ELSE '{{"input":' || CASE WHEN k = 0 THEN head ELSE '[' || sent || ']' END || CASE WHEN k = 2 THEN ',"instructions":' || tail ELSE '' END || CASE WHEN k = 4 THEN ',"max_output_tokens":7' ELSE '' END || ',"model":"m"' || CASE WHEN k = 1 THEN ',"stream":true' ELSE '' END || CASE WHEN k = 4 THEN ',"top_p":0.5' ELSE '' END || '}}' END AS whole
  FROM n JOIN c USING (conv_id)),
p AS (SELECT *, unnest(['anthropic', 'gemini', 'deepseek', 'openai', 'other']) AS provider FROM b),
e AS (SELECT *, provider = 'openai' OR provider = 'deepseek' AND route = 'chat' AS same, CASE
  WHEN provider = 'other' THEN 'provider' WHEN same THEN NULL
  WHEN route = 'chat' THEN CASE WHEN k IN (1, 2) THEN 'field' WHEN k = 3 AND second THEN 'roles' WHEN k = 5 AND opens OR k = 6 AND second THEN 'message field' END
  ELSE CASE WHEN k = 1 AND provider = 'deepseek' THEN 'responses_streaming' WHEN k = 2 AND tail_filled THEN 'field' WHEN k = 3 AND second THEN 'responses_multimodal' WHEN k = 7 AND second THEN 'responses_roles' WHEN hollow THEN 'responses_input' END END AS error
  FROM (SELECT p.*, c.tail <> '""' AS tail_filled FROM p JOIN c USING (conv_id)))
SELECT conv_id, route, provider, error, CASE WHEN error IS NOT NULL THEN NULL WHEN same THEN whole
  WHEN provider = 'anthropic' THEN '{{"max_tokens":' || CASE WHEN k = 4 THEN 7 ELSE 1024 END || ',"messages":[' || claude || '],"model":"m"' || CASE WHEN sys IS NULL OR sys = 'null' THEN '' ELSE ',"system":' || sys END || CASE WHEN k <> 4 THEN '' WHEN route = 'chat' THEN ',"temperature":0.5' ELSE ',"top_p":0.5' END || '}}'
  WHEN provider = 'gemini' THEN '{{"contents":[' || google || ']' || CASE WHEN k <> 4 THEN '' WHEN route = 'chat' THEN ',"generationConfig":{{"maxOutputTokens":7,"temperature":0.5}}' ELSE ',"generationConfig":{{"maxOutputTokens":7,"topP":0.5}}' END || CASE WHEN sysparts IS NULL THEN '' ELSE ',"systemInstruction":{{"parts":[' || sysparts || ']}}' END || '}}'
  ELSE '{{' || CASE WHEN k = 4 THEN '"max_tokens":7,' ELSE '' END || '"messages":[' || deep || '],"model":"m"' || CASE WHEN k = 4 THEN ',"top_p":0.5' ELSE '' END || '}}' END AS request FROM e"""
    answers = f"""WITH t AS (SELECT conv_id, turn, ['anthropic', 'gemini', 'deepseek', 'openai'][(conv_id + turn) % 4 + 1] AS provider, CASE WHEN turn <> 6 THEN text END AS x FROM conversations),
a AS (SELECT conv_id, turn, provider, CASE provider WHEN 'anthropic' THEN CASE WHEN x = '' THEN 'end' ELSE x || chr(10) || 'end' END WHEN 'gemini' THEN nullif(x, '') ELSE x END AS text FROM t),
j AS (SELECT *, to_json(text)::VARCHAR AS j FROM a)
SELECT conv_id, turn, provider, text,
  CASE WHEN text IS NOT NULL THEN '{{"id":"' || conv_id || '","object":"chat.completion","created":' || turn || ',"model":"m","choices":[{{"index":0,"message":{{"role":"assistant","content":' || j || '}},"finish_reason":"stop"}}]}}' END AS chat,
  CASE WHEN text IS NOT NULL THEN '{{"id":"' || conv_id || '","object":"response","created":' || turn || ',"model":"m","output":[{{"type":"message","role":"assistant","content":[{{"type":"output_text","text":' || j || '}}]}}],"output_text":' || j || ',"status":"completed"}}' END AS responses FROM j"""
    return {"payload_texts": texts, "provider_requests": requests, "provider_answers": answers}
