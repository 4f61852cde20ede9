"""Vaults of streams: restarts, late rows, times to live, and what is written to the state store."""

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import lifecycle, vault
from palimpsest.sources.patterns import load
from palimpsest.streaming import vault_stream

#: Fewer patterns make the plans of each batch shorter.
FEW = [p for p in load() if p.name in ("email", "nigerian_bvn")]
SCHEMA = "session_id string, request_order long, text string, at timestamp"


@pytest.fixture
def streaming(spark):
    settings = {"spark.sql.streaming.stateStore.providerClass": vault_stream.PROVIDER, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield spark
    for k in settings:
        spark.conf.unset(k)


def table(spark, rows):
    df = spark.createDataFrame(rows, "session_id string, request_order long, text string, at long")
    return df.withColumn("at", F.timestamp_seconds("at"))


def played(spark, tmp_path, batches, **kw):
    """Rows of a stream that gets the batches one by one and starts again for each, and each batch's progress."""
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    progress = []
    for rows in batches:
        table(spark, rows).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        q = vault_stream.tokenized_stream(stream, **kw).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        progress.append(q.lastProgress)
    return {(r.session_id, r.request_order): r for r in spark.read.parquet(out).collect()}, progress


ONE, TWO, THREE = "12345678901", "10987654321", "22233344455"
FIRST = [("s1", 1, f"mail a@b.com and {ONE}, again a@b.com; password = hunter2hunter2", 0), ("s2", 1, TWO, 10), (None, 1, f"no session {ONE}", 10), (None, 2, "nothing", 10), ("s3", 1, None, 20)]
THEN = [("s1", 2, f"{ONE} then {TWO}", 60), ("s1", 3, "nothing", 70), ("s2", 2, f"{ONE} {TWO}", 5000), ("s1", 4, f"{TWO} {THREE}", 3700), ("s1", 5, f"{ONE} {TWO}", 9000)]


def test_stream_equals_batch(streaming, tmp_path):
    got, _ = played(streaming, tmp_path, [FIRST, THEN], at="at")
    out, tokens = lifecycle.tokenize_with_expiry(table(streaming, FIRST + THEN))
    want = {(r.session_id, r.request_order): r for r in out.collect()}
    assert {k: r.sanitized_text for k, r in got.items()} == {k: r.sanitized_text for k, r in want.items()}
    assert {k: r.error for k, r in got.items()} == {k: r.error for k, r in want.items()}
    assert got[None, 1].error == "token_missing" and got[None, 2].sanitized_text == "nothing" and got["s3", 1].sanitized_text == ""
    assert [got["s1", k].epoch for k in range(1, 6)] == [0, 0, 0, 1, 2]
    made = {(r.session_id, r.epoch, m.matched): (m.gen_key, m.seq, m.token) for r in got.values() for m in r.made}
    assert made == {(r.session_id, r.epoch, r.matched): (r.gen_key, r.seq, r.token) for r in tokens.where("session_id is not null").collect()}


def test_late_rows(streaming, tmp_path):
    batches = [
        [("a", 1, ONE, 0), ("b", 1, ONE, 0)],
        [("b", 2, "clock", 20_000)],  # the watermark passes a's life
        [("b", 3, "clock", 20_010)],  # a's timer
        [("a", 2, f"{TWO} {ONE}", 100), ("b", 4, ONE, 100)],  # hours late: answered, from a new vault and from the one there is
        [("a", 3, ONE, 200)],
    ]
    got, progress = played(streaming, tmp_path, batches, at="at", delay="1 minute", patterns=FEW)
    assert len(got) == 7 and all(p["stateOperators"][0]["numRowsDroppedByWatermark"] == 0 for p in progress)
    assert got["a", 1].sanitized_text == "00000000001" and got["a", 2].epoch == 1
    assert got["a", 2].sanitized_text == "00000000002 00000000001"  # numbers go from the end of a text
    assert got["b", 2].epoch == got["b", 4].epoch == 1 and got["b", 4].sanitized_text == "00000000001"


def test_state_written_follows_new_values(streaming, tmp_path):
    many = " and ".join(f"n{k}@mail.com" for k in range(1000, 1400))
    got, progress = played(streaming, tmp_path, [[("s", 1, many, 0)], [("s", 2, f"n1007@mail.com, {ONE}", 10)]], patterns=FEW)
    updated = [p["stateOperators"][0]["numRowsUpdated"] for p in progress]
    assert got["s", 1].tokenized_count == len(got["s", 1].made) == 400 and got["s", 2].tokenized_count == 2 and len(got["s", 2].made) == 1
    assert updated[0] >= 400 and updated[1] <= 8


def test_full_vault(streaming, tmp_path):
    got, _ = played(streaming, tmp_path, [[("s", 1, ONE, 0), ("s", 2, f"{ONE} {TWO}", 1), ("s", 3, ONE, 2)]], at="at", max_tokens=1, patterns=FEW)
    assert got["s", 1].error is None and got["s", 2].error == "vault_full" and got["s", 2].sanitized_text is None
    assert got["s", 3].sanitized_text == got["s", 1].sanitized_text


def test_table_as_one_batch(streaming):
    rows = table(streaming, [r for r in FIRST + THEN if r[0]])
    want = {(r.session_id, r.request_order): r.sanitized_text for r in lifecycle.tokenize_with_expiry(rows)[0].collect()}
    assert {(r.session_id, r.request_order): r.sanitized_text for r in vault_stream.tokenized_stream(rows, at="at").collect()} == want
    whole = vault_stream.tokenized_stream(rows)  # without times nothing expires within a batch
    assert {(r.session_id, r.request_order): r.sanitized_text for r in whole.collect()} == {(r.session_id, r.request_order): r.sanitized_text for r in vault.tokenize(rows)[0].collect()}
    assert vault_stream.tokenized_stream(rows.where("false"), at="at").count() == 0
