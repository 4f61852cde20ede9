"""Tokens, vaults, resolving, encryption and the stream."""

import json

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import rewrite, sealed, tokens, vault
from palimpsest.streaming import vault_stream


@pytest.mark.parametrize(
    ("kind", "value", "n", "token"),
    [
        ("email", "ada@gmail.com", 1, "usa@examp.eac"), ("numeric", "12345678901", 1, "00000000001"), ("phone", "+2348012345678", 1, "+2340000000001"),
        ("phone", "0803 123-4567", 12, "0000 000-0012"), ("iban", "GB29NWBK60161331926819", 1, "GB00XXXX00000000000001"), ("default", "ABcd-1234", 1, "XXxx-0001"),
        ("default", "DEUTDEFF", 1, "XXXXXXXA"), ("default", "DEUTDEFF", 27, "XXXXXXBA"), ("default", "--", 3, "--"), ("email", "nothing", 2, "xxxxxxb"), ("email", "ab12@x.io", 7, "us07@e.am"),
    ],
)
def test_tokens(kind, value, n, token):
    assert tokens.MAKERS[kind](value, n) == token
    assert len(token) == len(value)


def test_too_long():
    for kind, value, n in (("numeric", "12", 100), ("numeric", "", 1), ("iban", "GB", 1), ("default", "a", 27)):
        with pytest.raises(tokens.TokenLengthExceeded):
            tokens.MAKERS[kind](value, n)


def test_fragments():
    assert tokens.email_fragments("ada@gmail.com", "usa@examp.eac") == {"examp.eac": "gmail.com", "eac": "com", "examp": "gmail", "usa": "ada"}


REQUESTS = [
    ("s1", 1, "mail a@b.com and 12345678901, again a@b.com; password = hunter2hunter2"), ("s1", 2, "12345678901 then 10987654321"), ("s2", 1, "10987654321"),
    ("s1", 3, "nothing"), (None, 1, "no session c@d.com"), ("s3", 1, None),
]


def requests(spark):
    return spark.createDataFrame(REQUESTS, "session_id string, request_order long, text string")


def test_vault(spark):
    out, made = vault.tokenize(requests(spark))
    table = {(r.session_id, r.matched): (r.gen_key, r.seq, r.token) for r in made.collect()}
    assert table["s1", "a@b.com"][1] == 1 and table["s1", "12345678901"] == ("numeric", 1, "00000000001")
    assert table["s1", "10987654321"][2] == "00000000002" and table["s2", "10987654321"][2] == "00000000001"
    rows = {(r.session_id, r.request_order): r for r in out.collect()}
    assert len(rows) == len(REQUESTS)
    assert rows["s1", 2].sanitized_text == "00000000001 then 00000000002" and rows["s1", 1].tokenized_count == 3 and rows["s1", 1].redacted_count == 4
    assert "[REDACTED_PASSWORD]" in rows["s1", 1].sanitized_text and rows["s1", 3].safe
    reverse = vault.reverse_map(made, vault.vault_subtokens(made).where("false"))
    bodies = out.where("session_id is not null").select("session_id", "request_order", F.col("sanitized_text").alias("body"))
    back = {(r.session_id, r.request_order): (r.resolved_text, r.resolve_status) for r in vault.resolve(bodies, reverse).collect()}
    assert back["s1", 2] == ("12345678901 then 10987654321", "success") and back["s3", 1] == (None, "vault_expired")


def test_numbers_go_from_the_end_of_a_text(spark):
    df = spark.createDataFrame([("s", 1, "22222222222 or 33333333333")], "session_id string, request_order long, text string")
    assert vault.tokenize(df)[0].first().sanitized_text == "00000000002 or 00000000001"


def test_capacity(spark):
    out, made = vault.tokenize(requests(spark).where("session_id = 's1'"), max_tokens=2)
    assert {r.error for r in made.collect()} == {None, "vault_full"}
    rows = {r.request_order: r for r in out.collect()}
    assert rows[1].error is None and rows[2].error == "vault_full" and rows[2].sanitized_text is None


def test_fragment_conflicts_delete(spark):
    rows = [("s", "a@one.com", "email", "email", 1, (1, 0), "u@exa.eac", None), ("s", "b@two.com", "email", "email", 2, (2, 0), "v@exa.eac", None), ("s", "c@six.com", "email", "email", 3, (3, 0), "w@exa.eac", None)]
    made = spark.createDataFrame(rows, "session_id string, matched string, pattern string, gen_key string, seq int, ord struct<req:long,back:int>, token string, error string")
    got = {r.fragment: r.original for r in vault.vault_subtokens(made).collect()}
    assert got == {"u": "a", "v": "b", "w": "c", "eac": "com", "exa": "six", "exa.eac": "six.com"}


def test_session_ids(spark):
    r = spark.range(1).select(vault.new_session_id().alias("s")).select("s", vault.is_session_id(F.col("s")).alias("ok"), vault.is_session_id(F.lit("bad")).alias("bad"), vault.is_session_id(F.lit(None).cast("string")).alias("none")).first()
    assert r.ok and not r.bad and not r.none


def test_seal(spark):
    _, made = vault.tokenize(requests(spark).where("session_id is not null"))
    old, new = sealed.StaticKeys("k1", b"1" * 32), sealed.StaticKeys("k2", b"2" * 32, {"k1": b"1" * 32})
    path = made.sparkSession.conf.get("spark.checkpoint.dir") + "/sealed"
    sealed.seal(made, old).write.mode("overwrite").parquet(path)
    stored = spark.read.parquet(path)
    opened = sealed.unseal(stored, new).collect()
    assert {r.status for r in opened} == {"ok"} and {m["token"] for r in opened if r.session_id == "s2" for m in json.loads(r.state)} == {"00000000001"}
    assert {r.status for r in sealed.unseal(stored, sealed.StaticKeys("k3", b"3" * 32)).collect()} == {"unknown_key"}
    assert {r.status for r in sealed.unseal(stored, sealed.StaticKeys("k1", b"9" * 32)).collect()} == {"wrong_key"}
    assert {r.status for r in sealed.unseal(stored.withColumn("ciphertext", F.lit(bytearray(b"x" * 40))), new).collect()} == {"corrupt"}
    save = stored.withColumn("base_version", F.lit(1).cast("long"))
    assert {r.payload_version for r in sealed.merged(stored, save).collect()} == {2}
    assert {r.payload_version for r in sealed.merged(stored, save.withColumn("base_version", F.lit(0).cast("long"))).collect()} == {1}
    with pytest.raises(ValueError):
        sealed.StaticKeys("k", b"short")


def test_redacted_stream(spark, tmp_path):
    spark.createDataFrame([("a@b.co",)], "text string").write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("text string").parquet(str(tmp_path / "in"))
    q = vault_stream.redacted_stream(src).select("sanitized_text").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.sanitized_text for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["[REDACTED_EMAIL]"]
