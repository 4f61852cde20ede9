"""Translations and texts of payloads as expressions, held against plain Python on random payloads."""

import json
import random

import plain_translation as plain
from pyspark.sql import functions as F

from palimpsest.operators import payload, providers

ODD = [None, "", "x", 0, 1, 0.5, True, False, [], {}, ["a"], {"a": 1}]


def _maybe(rnd, usual, p=0.85):
    return usual() if rnd.random() < p else rnd.choice(ODD)


def _with(rnd, fields, extra, p=0.12):
    out = {k: _maybe(rnd, v) for k, v in fields.items() if rnd.random() > 0.04}
    if rnd.random() < p:
        out[rnd.choice(extra)] = rnd.choice(ODD)
    return out


def _text(rnd):
    return rnd.choice(["", "a", 'q"uote\\', "line\nend", "é \U0001f600", "\x01 \t", "b" * 50])


def _payload(rnd, route):
    if rnd.random() < 0.02:
        return rnd.choice(ODD)
    role = lambda: rnd.choice(["system", "user", "assistant", "user"] + ["tool"] * (rnd.random() < 0.2))
    settings = {"model": lambda: "m", "temperature": lambda: 0.25, "top_p": lambda: 1, "stream": lambda: False}
    settings = {k: v for k, v in settings.items() if rnd.random() < 0.6}
    n = rnd.randrange(4)
    if route == "chat":
        message = lambda: _maybe(rnd, lambda: _with(rnd, {"role": role, "content": lambda: _text(rnd)}, ["name", "tool_calls"], 0.04), 0.97)
        return _with(rnd, settings | {"messages": lambda: [message() for _ in range(n)]} | ({"max_tokens": lambda: 9} if n > 1 else {}), ["stop", "seed", "tools", "tool_choice", "logit_bias", "response_format"])
    block = lambda: _maybe(rnd, lambda: _with(rnd, {"type": lambda: rnd.choice(["input_text"] * 9 + ["image"]), "text": lambda: _text(rnd)}, ["url"], 0.03), 0.98)
    message = lambda: _maybe(rnd, lambda: _with(rnd, {"content": lambda: [block() for _ in range(rnd.randrange(1, 3))]} | ({"role": role} if rnd.random() < 0.8 else {}), ["id"], 0.03), 0.97)
    given = (lambda: [message() for _ in range(n)]) if rnd.random() < 0.8 else (lambda: _text(rnd))
    return _with(rnd, settings | {"input": given} | ({"max_output_tokens": lambda: 9} if n > 1 else {}), ["instructions", "user", "store", "metadata", "previous_response_id", "tools", "parallel_tool_calls", "else"])


def _plain(body, route, provider):
    """The request, or why there is none: where the plain version fails on a malformed payload, anything but a request."""
    if not isinstance(body, dict):
        return "body"
    try:
        return plain.translate(body, route, provider)
    except plain.Unsupported as e:
        return str(e)
    except (AttributeError, TypeError):
        return "messages"


def _well_formed(body, route):
    """Contents that are neither strings nor null pass the plain version as they are; the expressions refuse them."""
    sent = body.get("messages") if isinstance(body, dict) and route == "chat" else None
    return sent is None or isinstance(sent, list) and all(isinstance(m, dict) and isinstance(m.get("content"), str | None) for m in sent)


def test_translations_equal_the_plain_version(spark):
    rnd = random.Random(5)
    asked = [(i, route, p, json.dumps(_payload(rnd, route), ensure_ascii=i % 2 == 0)) for i in range(800) for route in ("chat", "responses") for p in [rnd.choice(providers.PROVIDERS)]]
    df = spark.createDataFrame(asked, "i int, route string, p string, b string")
    made = lambda route: providers.provider_request(F.col("b"), F.col("p"), route)
    got = df.withColumn("r", F.when(F.col("route") == "chat", made("chat")).otherwise(made("responses"))).collect()
    translated = 0
    for r in got:
        body = json.loads(r.b)
        want = _plain(body, r.route, r.p)
        assert (r.r.request is None) != (r.r.error is None), r.b
        if r.r.request is not None:
            assert json.loads(r.r.request) == want, (r.b, r.p)
            translated += r.p not in ("openai",)
        elif _well_formed(body, r.route):
            assert r.r.error == want, (r.b, r.p)
        else:
            assert r.r.error in ("messages", "message content", "message field", "roles", "field"), (r.b, r.r.error)
    assert translated > 250 and len({r.r.error for r in got}) > 8


def test_bodies_that_are_no_objects(spark):
    rows = [("{",), (None,), ("[]",), ("1",), ('{"a":1,"a":2}',), ("",)]
    df = spark.createDataFrame(rows, "b string")
    for p in providers.PROVIDERS:
        assert {r[0].error for r in df.select(providers.provider_request(F.col("b"), F.lit(p), "chat")).collect()} == {"body"}
    assert {r[0].error for r in spark.createDataFrame([("{}", "other"), ("{}", None)], "b string, p string").select(providers.provider_request(F.col("b"), F.col("p"), "chat")).collect()} == {"provider"}
    assert all(r[0] == [] for kind in ("chat", "responses") for r in df.select(payload.texts_of(F.col("b"), kind)).collect())


def _walk(node, path):
    """(path, text) of all descriptions below a node."""
    pairs = node.items() if isinstance(node, dict) else enumerate(node) if isinstance(node, list) else ()
    for k, v in pairs:
        if k == "description" and isinstance(v, str):
            yield f"{path}/{k}", v
        else:
            yield from _walk(v, f"{path}/{k}")


def test_texts_equal_a_walk(spark):
    """All string contents and arguments of a chat, then descriptions at any depth; paths lead to the texts they stand beside."""
    rnd = random.Random(6)

    def tree(depth):
        if depth == 0:
            return rnd.choice(ODD)
        return {rnd.choice(["description", "a", "b"]): _maybe(rnd, lambda: rnd.choice([_text(rnd), tree(depth - 1), [tree(depth - 1)]])) for _ in range(3)}

    bodies = []
    for _ in range(300):
        messages = [_maybe(rnd, lambda: {"role": "user", "content": _maybe(rnd, lambda: _text(rnd)), "function_call": _maybe(rnd, lambda: {"arguments": _maybe(rnd, lambda: _text(rnd))}, 0.5), "tool_calls": _maybe(rnd, lambda: [_maybe(rnd, lambda: {"function": {"arguments": _text(rnd)}})], 0.6)}) for _ in range(rnd.randrange(4))]
        bodies.append({"messages": messages, "tools": [tree(rnd.randrange(3))]})
    deep = {"description": "deepest"}
    for _ in range(60):
        deep = {"a": [deep], "description": {"b": 1}}
    bodies[0]["tools"] = deep
    rows = spark.createDataFrame([(i, json.dumps(b)) for i, b in enumerate(bodies)], "i int, b string")
    for r in rows.select("i", payload.texts_of(F.col("b"), "chat").alias("t")).collect():
        body, got = bodies[r.i], [(t.path, t.text) for t in r.t]
        want = []
        for i, m in enumerate(x if isinstance(x, dict) else {} for x in body["messages"]):
            calls = m.get("tool_calls") if isinstance(m.get("tool_calls"), list) else []
            found = [("content", m.get("content")), ("function_call/arguments", m["function_call"].get("arguments") if isinstance(m.get("function_call"), dict) else None)]
            found += [(f"tool_calls/{j}/function/arguments", c["function"]["arguments"] if isinstance(c, dict) and "function" in c else None) for j, c in enumerate(calls)]
            want += [(f"/messages/{i}/{p}", t) for p, t in found if isinstance(t, str)]
        n = len(want)
        assert got[:n] == want and sorted(got[n:]) == sorted(_walk(body["tools"], "/tools"))
