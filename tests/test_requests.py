"""Requests, payloads, routing and the contextual model."""

import json

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import contextual, payload, providers, requests, rewrite, routing, vault
from palimpsest.plans.fixtures import ITEMS
import plain_translation as plain


def test_items(spark):
    got = {r.item_index: r for r in requests.run_batch(spark.createDataFrame(ITEMS, requests.ITEM)).collect()}
    assert {i: r.error_code for i, r in got.items()} == {0: None, 1: "missing_prompt", 2: "prompt_too_large", 3: "invalid_session_id", 4: "invalid_sanitization_mode", 5: None, 6: None}
    assert got[0].sanitized_prompt == "My email is [REDACTED_EMAIL]" and got[5].sanitized_prompt == "call [WARNING_KENYAN_PHONE] now"
    total = requests.summary(requests.run_batch(spark.createDataFrame(ITEMS, requests.ITEM))).first()
    assert tuple(total) == (7, 3, 4, 2, 2, 0)


def test_tokenize_mode(spark):
    session = "vlt_a7f3b2c1-4d5e-6f7a-8b9c-0d1e2f3a4b5c"
    items = spark.createDataFrame([(0, "a", "a@b.com", session, "tokenize", None), (1, "b", "a@b.com", session, None, None)], requests.ITEM)
    got = {r.item_index: r for r in requests.run_batch(items, mode="tokenize").collect()}
    assert got[0].sanitized_prompt == got[1].sanitized_prompt != "a@b.com" and got[0].tokenized_count == 1 and got[0].session_id == session


def test_store_errors(spark):
    """A session's vault that can't be had fails its items that make tokens, and no others."""
    ids = {s: f"vlt_{i}7f3b2c1-4d5e-6f7a-8b9c-0d1e2f3a4b5c" for i, s in enumerate(["ok", "unavailable", "conflict", "wrong_key", "corrupt", "new"])}
    rows = [(i, s, "a@b.com", v, "tokenize", None) for i, (s, v) in enumerate(ids.items())]
    rows += [(10, "redact", "a@b.com", ids["corrupt"], "redact", None), (11, "none", "a@b.com", None, "tokenize", None), (12, "empty", "", ids["corrupt"], "tokenize", None)]
    stored = spark.createDataFrame([(v, s) for s, v in ids.items() if s != "new"] + [(ids["unavailable"], "ok"), (None, "corrupt"), (ids["wrong_key"], "unavailable")], "session_id string, status string")
    got = {r.id: r for r in requests.run_batch(spark.createDataFrame(rows, requests.ITEM), stored=stored).collect()}
    assert len(got) == len(rows)
    want = {"unavailable": "session_store_unavailable", "conflict": "session_store_unavailable", "wrong_key": "sanitization_failed", "corrupt": "sanitization_failed", "empty": "missing_prompt"}
    assert {i: r.error_code for i, r in got.items() if r.error_code} == want
    assert all(r.ok == (i not in want) and (r.sanitized_prompt is None) == (i in want) for i, r in got.items())
    assert got["redact"].sanitized_prompt == "[REDACTED_EMAIL]" and "a@b.com" not in got["new"].sanitized_prompt


@pytest.mark.parametrize(
    ("body", "status"),
    [("{", 400), ('{"items": []}', 400), ("{}", 400), ('{"items": [{"prompt": "x"}], "more": 1}', 400), ('{"items": [{"prompt": "x", "odd": 1}]}', 400), ('{"items": [{"prompt": "x"}]} {}', 400), ('{"items": [' + ",".join(['{"prompt":"x"}'] * 101) + "]}", 400), ('{"items": [{"prompt": "' + "x" * 1048576 + '"}]}', 413)],
)
def test_envelopes(spark, body, status):
    with pytest.raises(requests.BadRequest) as e:
        requests.read_envelope(spark, body)
    assert e.value.status == status


def test_good_envelope(spark):
    assert requests.read_envelope(spark, '{"items": [{"id": "a", "prompt": "x", "slm": true}]}').first().slm is True


CHAT = {
    "model": "m", "messages": [{"role": "user", "content": "a@b.co"}, {"role": "assistant", "content": None, "tool_calls": [{"function": {"name": "f", "arguments": "{\"to\": \"c@d.co\"}"}}]}],
    "tools": [{"function": {"description": "mail e@f.co", "parameters": {"properties": {"x": {"description": "g@h.co"}, "description": {"description": "i@j.co"}}}}}],
}
RESPONSE = {"model": "m", "input": [{"role": "user", "content": [{"type": "input_text", "text": "a@b.co"}, {"type": "image", "text": "k@l.co"}]}], "instructions": "to c@d.co"}


@pytest.mark.parametrize(("kind", "body", "left"), [("chat", CHAT, []), ("responses", RESPONSE, ["k@l.co"]), ("responses", {"input": "a@b.co"}, [])])
def test_payload_texts(spark, kind, body, left):
    df = spark.createDataFrame([(1, json.dumps(body)), (2, "no json"), (3, None)], "k int, body string")
    got = {r.k: r.sanitized_body for r in payload.rewrite_payloads(df, "k", "body", kind, rewrite.sanitize).collect()}
    assert got[2] == "no json" and got[3] is None
    assert [w for w in got[1].replace('"', " ").replace("\\", " ").split() if "@" in w] == left and "[REDACTED_EMAIL]" in got[1]


def test_translations():
    chat = {"model": "c", "messages": [{"role": "system", "content": "s1"}, {"role": "system", "content": "s2"}, {"role": "user", "content": "u"}, {"role": "assistant", "content": "a"}], "top_p": 0.5}
    a = plain.translate(chat, "chat", "anthropic")
    assert a == {"model": "c", "system": "s1\ns2", "max_tokens": 1024, "top_p": 0.5, "messages": [{"role": "user", "content": [{"type": "text", "text": "u"}]}, {"role": "assistant", "content": [{"type": "text", "text": "a"}]}]}
    g = plain.translate(chat | {"max_tokens": 5}, "chat", "gemini")
    assert [c["role"] for c in g["contents"]] == ["user", "model"] and g["generationConfig"] == {"maxOutputTokens": 5, "topP": 0.5} and len(g["systemInstruction"]["parts"]) == 2
    assert "generationConfig" not in plain.translate({"messages": []}, "chat", "gemini")
    d = plain.translate({"model": "d", "input": "hi", "max_output_tokens": 3}, "responses", "deepseek")
    assert d == {"model": "d", "messages": [{"role": "user", "content": "hi"}], "max_tokens": 3}
    assert plain.translate({"any": 1}, "chat", "openai") == {"any": 1}


@pytest.mark.parametrize(
    ("body", "kind", "provider"),
    [({"messages": [], "seed": 1}, "chat", "anthropic"), ({"messages": [], "stop": "x"}, "chat", "gemini"), ({"messages": [{"role": "tool", "content": ""}]}, "chat", "gemini"), ({"messages": [{"role": "user", "name": "x"}]}, "chat", "anthropic"), ({"input": []}, "responses", "anthropic"), ({"input": [{"content": [{"type": "image"}]}]}, "responses", "gemini"), ({"input": "x", "stream": True}, "responses", "deepseek"), ({"input": "x", "instructions": "y"}, "responses", "gemini")],
)
def test_refused(body, kind, provider):
    with pytest.raises(plain.Unsupported):
        plain.translate(body, kind, provider)


def test_answers(spark):
    rows = [
        ("anthropic", '{"content":[{"type":"text","text":"a"},{"type":"tool"},{"type":"text","text":"b"}]}', "a\nb"), ("anthropic", '{"content":[]}', None),
        ("gemini", '{"candidates":[{"content":{"parts":[{"text":"x"},{"text":""}]}},{"content":{"parts":[{"text":"y"}]}}]}', "x\ny"), ("deepseek", '{"choices":[{"message":{"content":"z"}}]}', "z"), ("gemini", "{", None),
    ]
    df = spark.createDataFrame(rows, "p string, b string, want string").withColumn("t", providers.answer_text(F.col("b"), F.col("p")))
    df = df.withColumn("chat", providers.normal_answer(F.col("t"), F.lit("m"), "chat", F.lit("id"), F.lit(1))).withColumn("resp", providers.normal_answer(F.col("t"), F.lit("m"), "responses", F.lit("id"), F.lit(1)))
    for r in df.collect():
        assert r.t == r.want and (r.chat is None) == (r.want is None)
        if r.want:
            assert json.loads(r.chat)["choices"][0]["message"]["content"] == r.want and json.loads(r.resp)["output_text"] == r.want
    asked = spark.createDataFrame([('{"messages":[{"role":"user","content":"u"}]}', "anthropic"), ('{"messages":[],"x":1}', "gemini")], "b string, p string").select(providers.provider_request(F.col("b"), F.col("p"), "chat").alias("r")).collect()
    assert asked[0].r.error is None and asked[1].r.request is None


def test_routes(spark):
    exact, prefixes = routing.routes(spark, {"gpt-special": "gemini"}, (("gpt-", "openai"), ("gpt-4", "anthropic")))
    models = ["gpt-special", "gpt-4o", "gpt-3", "other", " ", None]
    got = {r.model: r.provider for r in routing.route(spark.createDataFrame([(m,) for m in models], "model string"), exact, prefixes, default="d").collect()}
    assert got == {"gpt-special": "gemini", "gpt-4o": "anthropic", "gpt-3": "openai", "other": "d", " ": None, None: None}
    r = spark.range(1).select(routing.session_or_new(F.lit("bad"), vault.PREFIX).alias("s"), routing.stream_mode(F.lit(True), F.lit("tokenize")).alias("m"), routing.model_family(F.lit("claude-x")).alias("f"), routing.resolve_gate(F.lit("tokenize"), F.lit(1), F.lit(False), F.lit(False)).alias("g")).first()
    assert r.s.startswith("vlt_") and (r.m, r.f, r.g) == ("redact", "claude", "error")


TOKENS = {
    "Amina Yusuf": [(0, 0, 1, "O", 1.0), (0, 5, 1, "B-private_person", 0.9), (5, 11, 1, "E-private_person", 0.7)],
    "Amina  Yusuf": [(0, 6, 1, "S-private_person", 0.8), (6, 12, 1, "S-private_person", 0.6), (0, 0, 1, "O", 1)],
    "é x": [(0, 1, 1, "O", 1.0), (1, 3, 1, "U-secret", 0.5)],
    "a b c": [(0, 1, 1, "I-private_url", 1.0), (2, 3, 1, "I-private_date", 1.0), (4, 5, 0, "B-secret", 1.0)],
}


def test_contextual(spark):
    def stub():  # nested, so that workers get it by value
        def run(texts):
            if any(t == "fail" for t in texts):
                raise RuntimeError
            return [TOKENS.get(t, []) for t in texts]

        return run

    df = spark.createDataFrame([(t, True) for t in TOKENS] + [("Amina Yusuf", False), (None, True), ("x" * 20000, True)], "text string, slm boolean")
    got = contextual.score(df, stub, enabled="slm").withColumn("v", contextual.model_violations(F.col("model_spans"))).collect()
    by = {(r.text, r.slm): r for r in got}
    one = by["Amina Yusuf", True].model_spans[0]
    assert (one.label, one.start, one.end, round(one.score, 3)) == ("private_person", 0, 11, 0.8) and by["Amina Yusuf", False].model_spans == []
    assert [(s.start, s.end) for s in by["Amina  Yusuf", True].model_spans] == [(0, 12)]
    assert [(v.pattern, v.position, v.end, v.matched) for v in by["é x", True].v] == [("slm_secret", 3, 4, "x")]
    assert [v.pattern for v in by["a b c", True].v] == ["slm_url", "slm_date"]
    assert contextual.score(spark.createDataFrame([("fail",), ("Amina Yusuf",)], "text string").coalesce(1), stub, batch=1).where("size(model_spans) > 0").count() == 1


def test_breaker_and_labels():
    now = [0.0]
    b = contextual.Breaker(2, 30, lambda: now[0])
    b.record(False)
    assert b.allows()
    b.record(False)
    assert not b.allows()
    now[0] = 31
    assert b.allows()
    b.record(True)
    assert b.allows() and contextual.label_table({"secret": ("", "WARN", "")})["secret"] == ("credential", "WARN", "slm_secret")
