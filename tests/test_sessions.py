"""Life cycle of vaults, overlap in clusters, resolving by automaton and decoding of tags, against plain Python."""

import random
import re
import time
from datetime import datetime, timedelta, timezone

import pandas as pd
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import contextual, lifecycle, overlap, vault
from palimpsest.operators.detect import detect
from palimpsest.operators.rewrite import sanitize
from palimpsest.operators.spans import SPANS

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
CALLS = "store string, session_id string, at timestamp, request_order long, action string"


def calls(rng, n, sessions=9, stores=("a", "b"), span=4000):
    rows = []
    for i in range(n):
        s = rng.randrange(sessions)
        rows.append((stores[s % len(stores)], f"s{s}", T0 + timedelta(seconds=rng.randrange(span)), i, rng.choice(["begin"] * 5 + ["get"] * 2 + ["delete"])))
    return rows


def test_epochs_and_live_vaults(spark):
    rng = random.Random(4)
    rows = [r for r in calls(rng, 300) if r[4] == "begin"] + [("a", "s1", T0 + timedelta(seconds=9000), 900, "begin"), ("a", "s1", T0 + timedelta(seconds=9100), 901, "begin"), ("a", None, T0, 902, "begin")]
    df = spark.createDataFrame(rows, CALLS)
    got = {(r.session_id, r.request_order): r.epoch for r in lifecycle.epochs(df, ttl_s=100).collect()}
    assert got[None, 902] is None
    # The time of expiry itself is too late: after exactly a hundred seconds a new vault begins.
    assert got["s1", 901] == got["s1", 900] + 1
    made = {}
    for _, s, at, i, _ in sorted((r for r in rows if r[1]), key=lambda r: (r[1], r[2], r[3])):
        last = made.get(s)
        if last is None or at - last[-1][2] >= timedelta(seconds=100):
            made.setdefault(s, []).append([at, 0, at])
        made[s][-1][1] += 1
        made[s][-1][2] = at
        assert got[s, i] == len(made[s]) - 1
    every = [(a, s, e, last + timedelta(seconds=100), n) for s, vs in made.items() for e, (a, n, last) in enumerate(vs)]
    want = {(s, e, n, sum((a2, s2, e2) <= (a, s, e) and b2 > a for a2, s2, e2, b2, _ in every)) for a, s, e, _, n in every}
    assert {(r.session_id, r.epoch, r.requests, r.live) for r in lifecycle.vaults(df, ttl_s=100).collect()} == want


class PlainStore:
    """The rules, call by call, without heaps."""

    def __init__(self, ttl, most):
        self.ttl, self.most, self.held, self.made = timedelta(seconds=ttl), most, {}, {}

    def call(self, s, at, action):
        if action == "delete":
            self.held.pop(s, None)
            return None, "ok"
        if s in self.held and self.held[s] > at:
            self.held[s] = at + self.ttl
            return self.made[s] - 1, "ok"
        was = self.held.pop(s, None)
        if action == "get":
            return None, "vault_not_found" if was is None else "session_expired"
        if len(self.held) >= self.most:
            self.held = {k: v for k, v in self.held.items() if v > at}
        if len(self.held) >= self.most:
            return None, "vault_full"
        self.held[s] = at + self.ttl
        self.made[s] = self.made.get(s, 0) + 1
        return self.made[s] - 1, "ok"


@pytest.mark.parametrize("most", [1, 2, 50])
def test_replayed_calls(spark, most):
    rows = calls(random.Random(most), 400) + [("a", None, T0, 990, "begin"), ("a", "s0", None, 991, "begin")]
    got = {r.request_order: (r.epoch, r.status) for r in lifecycle.replayed(spark.createDataFrame(rows, CALLS), ttl_s=100, max_vaults=most).collect()}
    want, stores = {}, {}
    for store, s, at, i, action in sorted((r for r in rows if r[1] and r[2]), key=lambda r: (r[0], r[2], r[1], r[3])):
        want[i] = stores.setdefault(store, PlainStore(100, most)).call(s, at, action)
    assert got == want
    assert ("vault_full" in {s for _, s in want.values()}) == (most < 50)


def test_tokens_begin_anew_after_expiry(spark):
    rows = [("s#1", T0, 1, "11111111111"), ("s#1", T0 + timedelta(seconds=50), 2, "22222222222 and 11111111111"), ("s#1", T0 + timedelta(seconds=200), 3, "33333333333"), (None, T0, 4, "44444444444"), (None, T0, 5, "nothing")]
    out, tokens = lifecycle.tokenize_with_expiry(spark.createDataFrame(rows, "session_id string, at timestamp, request_order long, text string"), ttl_s=100)
    assert {(r.session_id, r.epoch, r.matched, r.token) for r in tokens.where("session_id is not null").collect()} == {("s#1", 0, "11111111111", "00000000001"), ("s#1", 0, "22222222222", "00000000002"), ("s#1", 1, "33333333333", "00000000001")}
    rows = {r.request_order: r for r in out.collect()}
    assert rows[2].sanitized_text == "00000000002 and 00000000001" and rows[3].epoch == 1 and rows[5].sanitized_text == "nothing"
    # A value that has no token is an error, not a label.
    assert rows[4].error == "token_missing" and rows[4].sanitized_text is None


def plain_greedy(spans):
    ranks = [overlap.SEVERITY_RANK, overlap.TYPE_RANK, overlap.PATTERN_RANK]
    kept = []
    for x in sorted(spans, key=lambda x: (*(-r.get(v, 0) for r, v in zip(ranks, (x[1], x[0], x[2]), strict=True)), x[4] - x[5], x[4], x[2], x[3])):
        if not any(k[4] < x[5] and x[4] < k[5] for k in kept):
            kept.append(x)
    return sorted(kept, key=lambda x: (x[4], x[5], *x[:4])) if len(spans) > 1 else kept


def test_overlap_in_clusters(spark):
    rng = random.Random(6)
    rows = []
    for i in range(400):
        spans = []
        for _ in range(rng.randint(0, 14)):
            at = rng.randrange(60)
            size = rng.choice([0, 1, 3, 3, 8, 30])
            spans.append((rng.choice(["pii", "financial", "credential", "odd"]), rng.choice(["BLOCK", "WARN", "LOG"]), rng.choice(["email", "aws_access_key", "iban", "slm_secret"]), "x" * size, at, at + size))
        rows.append((i, spans))
    got = spark.createDataFrame(rows, f"i int, v {SPANS}").select("i", overlap.resolved(F.col("v")).alias("v")).collect()
    for r in got:
        assert sorted(map(tuple, r.v)) == sorted(plain_greedy(rows[r.i][1]))
        assert [(x.position, x.end) for x in r.v] == sorted((x.position, x.end) for x in r.v) or len(r.v) < 2


def test_overlap_of_very_many_spans(spark):
    one = lambda i: F.struct(F.lit("pii").alias("type"), F.lit("WARN").alias("severity"), F.lit("email").alias("pattern"), F.lit("abc").alias("matched"), (i * 4).cast("int").alias("position"), (i * 4 + 3).cast("int").alias("end"))
    spans = spark.range(100_000).select(one(F.col("id")).alias("x")).groupBy().agg(F.collect_list("x").cast(SPANS).alias("v"))
    spans.select(overlap.resolved(F.slice("v", 1, 10)).alias("v")).collect()
    began = time.time()
    assert spans.select(F.size(overlap.resolved(F.col("v"))).alias("n")).first().n == 100_000
    assert time.time() - began < 20  # some 2 s; comparing all pairs takes minutes


def test_columns_of_any_name(spark):
    df = spark.createDataFrame([("mail a@b.co", 1)], "`my text` string, `a.b` int")
    assert sanitize(df, "my text").first().sanitized_text == "mail [REDACTED_EMAIL]"
    assert [v.matched for v in detect(df.withColumnRenamed("my text", "it's; --"), "it's; --").first().violations] == ["a@b.co"]
    assert set(detect(df, "my text").columns) == {"my text", "a.b", "violations"}


def plain_replace(body, entries):
    keys = sorted((k for k in entries if k), key=lambda k: -len(k))
    return re.sub("|".join(map(re.escape, keys)), lambda m: entries[m[0]], body) if keys else body


@pytest.mark.parametrize("rows_per_part", [100_000, 3])
def test_resolve_replaces_leftmost_longest(spark, rows_per_part):
    rng = random.Random(9)
    letters = "abé\\.$"
    word = lambda most: "".join(rng.choice(letters) for _ in range(rng.randint(1, most)))
    maps = {f"s{i}": {word(5): word(3) for _ in range(rng.randint(0, 8))} for i in range(12)}
    rows = [(f"s{i % 14}" if i % 15 else None, i, None if i % 29 == 28 else "".join(rng.choice(letters + " ") for _ in range(rng.randint(0, 40))), "x", (i, "y")) for i in range(200)]
    df = spark.createDataFrame(rows, "session_id string, `n.o` long, body string, _part string, extra struct<a:int,row:string>")
    out = vault.resolve(df, spark.createDataFrame(list(maps.items()), "session_id string, reverse map<string,string>"), rows_per_part=rows_per_part)
    assert out.columns == [*df.columns, "resolved_text", "resolve_status"]
    got = {r["n.o"]: r for r in out.collect()}
    assert len(got) == 200
    for s, i, body, _, extra in rows:
        r = got[i]
        assert tuple(r.extra) == extra and r.body == body
        known = s in maps
        assert r.resolve_status == ("success" if known else "vault_expired")
        assert r.resolved_text == (None if not known or body is None else plain_replace(body, maps[s]))


def test_resolve_with_fragments(spark):
    reverse = spark.createDataFrame([("s", {"abc@defgh.ijk": "x@gmail.com", "ijk": "com"})], "session_id string, reverse map<string,string>")
    df = spark.createDataFrame([("s", "The email is abc@defgh.ijk and TLD is ijk"), ("s", "")], "session_id string, body string")
    assert {r.resolved_text for r in vault.resolve(df, reverse).collect()} == {"The email is x@gmail.com and TLD is com", ""}


def test_resolve_speed():
    import ahocorasick

    entries = {f"user{i:05d}@ex{i % 97}.com": f"name{i}@host.org" for i in range(1000)}
    keys = ahocorasick.Automaton()
    for k, v in entries.items():
        keys.add_word(k, (len(k), v))
    keys.make_automaton()
    rng = random.Random(2)
    body = " ".join(rng.choice(list(entries)) if rng.random() < 0.1 else "plain words" for _ in range(900))[:10240]
    began = time.perf_counter()
    for _ in range(200):
        vault.replaced(body, keys)
    assert 200 * len(body) / 1e6 / (time.perf_counter() - began) > 10  # some 60 MB/s on a free core


def spans_of(text, tokens):
    """Decoding by regular expression: a sign for each token, spans are its matches."""
    signs, seen = [], [(i, *t) for i, t in enumerate(tokens) if t[2]]
    labels = []
    for i, start, end, _, tag, _ in seen:
        m = re.fullmatch(r"(?s)([BIOESLU])-(.+)", tag)
        prefix, label = (m[1], m[2]) if m else ("B", tag)
        out = prefix == "O" or tag in ("", "O") or (i > 0 and start == end == 0)
        labels.append(label)
        signs.append("O" if out else {"B": "B", "U": "S", "S": "S", "I": "I", "E": "E", "L": "E"}[prefix])
    found, at = [], 0
    while at < len(signs):
        if signs[at] == "O":
            at += 1
            continue
        stop = at + 1
        if signs[at] in "BI":
            while stop < len(signs) and signs[stop] in "IE" and labels[stop] == labels[at]:
                stop += 1
                if signs[stop - 1] == "E":
                    break
        own = seen[at:stop]
        found.append((labels[at], own[0][1], own[-1][2], sum(t[5] for t in own) / len(own)))
        at = stop
    out = []
    for label, start, end, score in sorted(found, key=lambda s: s[1:3]):
        piece = text[start:end]
        if piece.strip():
            start, end = start + len(piece) - len(piece.lstrip()), start + len(piece.rstrip())
            if out and out[-1][0] == label and not text[out[-1][2] : start].strip():
                out[-1] = (label, out[-1][1], end, (out[-1][3] + score) / 2)
            else:
                out.append((label, start, end, score))
    return [(label, text[s:e], len(text[:s].encode()), len(text[:e].encode()), round(v, 9)) for label, s, e, v in out]


def test_decoding_of_tags():
    rng = random.Random(7)
    texts, tokens = [], []
    for _ in range(300):
        text = "".join(rng.choice("aé 世 \n") for _ in range(rng.randint(0, 30)))
        cuts = sorted(rng.sample(range(len(text) + 1), rng.randint(0, min(8, len(text) + 1))))
        own = [(0, 0, 1, "O", 1.0)] if rng.random() < 0.5 else []
        for a, b in zip(cuts, cuts[1:], strict=False):
            own.append((a, b, int(rng.random() < 0.9), rng.choice(["B-x", "I-x", "E-x", "S-x", "U-y", "I-y", "L-y", "O", "", "x", "O-x", "B-y"]), rng.random()))
        texts.append(text)
        tokens.append([*own, (0, 0, 1, "I-x", 0.5)])
    names = ("start", "end", "mask", "tag", "score")
    found = contextual._decoded(pd.Series([*texts, None, "x"]), pd.Series([*[[dict(zip(names, t, strict=True)) for t in own] for own in tokens], [], None]))
    assert found.iloc[-2] is None and found.iloc[-1] is None
    for text, own, got in zip(texts, tokens, found, strict=False):
        assert [(s["label"], s["text"], s["start"], s["end"], round(s["score"], 9)) for s in got] == spans_of(text, own)


def test_groups_of_matches_are_those_in_the_text(spark):
    """Secrets' groups come from a match by itself, and texts without an AWS key's parts aren't searched."""
    from palimpsest.functions.dialect import to_java
    from palimpsest.operators import secrets
    from palimpsest.operators.spans import placed_matches

    rng = random.Random(12)
    parts = ["export ", "aws", "AWS_", "secret", "SECRET_", "access", "_ACCESS_", "key", "KEY", "awsSecretAccessKey", "session_token", "SessionToken", "api_key", "token", "password", "my ", "x.", "=", " = ", ":", " is ", "'", '"', "abc", "v1,", ";", "\n", "K", "ſecret", " ", "-", "_"]
    texts = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(3, 30)))) for i in range(6000)]
    df = spark.createDataFrame(texts, "i int, t string")
    for regex, groups in ((secrets.AWS_ASSIGNMENT, 6), (secrets.GENERIC_ASSIGNMENT, 3)):
        java = to_java(regex)
        whole = F.arrays_zip(*[F.regexp_extract_all("t", F.lit(java), F.lit(k)).alias(f"g{k}") for k in range(1, groups + 1)])
        ours = F.transform(placed_matches(F.col("t"), java, groups), lambda x: F.struct(*[x[f"g{k}"].alias(f"g{k}") for k in range(1, groups + 1)]))  # noqa: B023
        # What a key is called is its groups together; only which branch has found it may differ.
        key = lambda x: F.concat(*[F.coalesce(x[f"g{k}"], F.lit("")) for k in range(1, groups - 1)])  # noqa: B023, E731
        flat = lambda c: F.transform(c, lambda x: F.struct(key(x), F.coalesce(x[f"g{groups - 1}"], F.lit("")), F.coalesce(x[f"g{groups}"], F.lit(""))))  # noqa: B023, E731
        rows = df.select("t", flat(whole).alias("a"), flat(ours).alias("b"), F.col("t").rlike(secrets.AWS_GATE).alias("gate")).where(F.size("a") > 0).collect()
        assert len(rows) > 200 and not [r.t for r in rows if list(map(tuple, r.a)) != list(map(tuple, r.b))][:3]
        assert groups == 3 or all(r.gate for r in rows)


def test_concurrent_saves_equal_a_replay(spark):
    from palimpsest.operators import saves

    rng = random.Random(5)
    stored, tokens, rows = {}, [], []
    for k in range(60):
        s, version = f"s{k}", rng.randint(0, 3)
        if version:
            stored[s] = version
            tokens += [(s, f"v{n}", "default", n + 1) for n in range(rng.randint(0, 3))]
        for i in range(rng.randint(0, 6)):
            base = rng.choice([version, version, rng.randint(0, 4), None])
            rows.append((s, 10 * i, base, [(f"v{rng.randrange(9)}", rng.choice(["passport", "email"])) for _ in range(rng.randint(0, 4))]))
    frame = spark.createDataFrame(rows, "session_id string, save_id long, base_version long, values array<struct<matched:string,pattern:string>>")
    outcome = saves.judged(frame, spark.createDataFrame(list(stored.items()), "session_id string, payload_version long"))
    held = spark.createDataFrame(tokens, "session_id string, matched string, gen_key string, seq int")
    got = {(r.session_id, r.save_id): (r.status, r.tries, r.payload_version) for r in outcome.collect()}
    vaults = {(s, m): (kind, n) for s, m, kind, n in tokens}
    want = {}
    for s in sorted({r[0] for r in rows}):
        version, pending = stored.get(s, 0), [[r[1], r[2] or 0, r[3]] for r in rows if r[0] == s]
        for tries in (1, 2, 3):
            winner = next((p for p in pending if p[1] == version), None)
            if winner:
                pending.remove(winner)
                version += 1
                want[s, winner[0]] = ("saved", tries, version)
                for m, pattern in winner[2]:
                    kind = "email" if pattern == "email" else "default"
                    vaults.setdefault((s, m), (kind, 1 + max([n for (x, _), (k, n) in vaults.items() if x == s and k == kind], default=0)))
            for p in pending:
                p[1] = version
        want |= {(s, p[0]): ("conflict", 3, None) for p in pending}
    assert got == want
    assert {(r.session_id, r.matched): (r.gen_key, r.seq) for r in saves.folded(held, outcome).collect()} == vaults


def test_envelopes_of_a_table(spark):
    import json

    from palimpsest.operators import requests

    rng = random.Random(3)
    bodies = ['{"items":[{"id":"a","prompt":"x"}]} ', '{"items":[{"prompt":null,"slm":false}]}', "", " ", "null", "[]", "7", '{"items":[]}]', '{"items":[{"id":"a"}],"x":1}', '{"items":"x"}', '{"items":[3]}', '{"items":[{"slm":"yes"}]}', '{"items":[{"id":"é","session_id":""}]}\n', None]
    good = '{"items":[{"id":"a","prompt":"x, y","session_id":"","sanitization_mode":"redact","slm":true},{"id":"b"}]}'
    for _ in range(150):
        at = rng.randrange(len(good))
        bodies.append(good[:at] + rng.choice(["", "]", "}", ",", '"', "x"]) + good[at + rng.randint(0, 2) :])

    def status(body):
        try:
            v = json.loads(body)
        except (ValueError, TypeError):
            return 400, "invalid JSON"
        if not isinstance(v, dict) or set(v) - {"items"} or not isinstance(v.get("items") or [], list) or v.get("items") is not None and not isinstance(v["items"], list):
            return 400, "unknown field"
        items = v.get("items") or []
        if not items:
            return 400, "no items"
        if any(not isinstance(x, dict) or set(x) - {"id", "prompt", "session_id", "sanitization_mode", "slm"} for x in items):
            return 400, "unknown field"
        if any(not isinstance(x[k], bool if k == "slm" else str) and x[k] is not None for x in items for k in x):
            return 400, "invalid JSON"
        return 200, None

    read = requests.envelopes(spark.createDataFrame(list(enumerate(bodies)), "i int, body string"))
    rows = {r.i: r for r in read.collect()}
    for i, body in enumerate(bodies):
        assert (rows[i].status, rows[i].reason) == status(body), body
    items = requests.envelope_items(read, "i").where("i = 0").collect()
    assert [(r.item_index, r.id, r.prompt, r.slm) for r in items] == [(0, "a", "x", None)]
