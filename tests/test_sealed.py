"""Keys of sealed vaults: they stay out of plans, rotate, and may stand behind a transport that fails."""

import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import sealed

OLD, NEW = b"\x11" * 32, b"\x22" * 32
TOKENS = "session_id string, ord int, matched string, token string, gen_key string, seq int"


def _tokens(spark, n=6):
    rows = [(f"s{i}", j, f"value{j}", f"T{j}", "default", j) for i in range(n) for j in range(1, 4)]
    return spark.createDataFrame(rows, TOKENS)


def _stored(spark, df, name):
    path = f"{spark.conf.get('spark.checkpoint.dir')}/{name}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _service(fails=(), refuses=()):
    """A key service in one function: what it wraps is the value, a check and the key's name."""

    def call(action, key_id, values):
        if action in fails:
            raise sealed.KeyServiceError("away")
        pad = hashlib.sha256(key_id.encode()).digest()
        out = []
        for v in map(base64.b64decode, values):
            if action == "wrap":
                out.append(base64.b64encode(bytes(a ^ b for a, b in zip(v, pad)) + hashlib.sha256(pad + v).digest()[:8]).decode())
            else:
                plain = bytes(a ^ b for a, b in zip(v[:32], pad))
                good = hashlib.sha256(pad + plain).digest()[:8] == v[32:] and key_id not in refuses
                out.append(base64.b64encode(plain).decode() if good else None)
        return out

    return call


def _statuses(df, provider):
    return {r.session_id: r.status for r in sealed.unseal(df, provider).collect()}


def _plans(df):
    q = df._jdf.queryExecution()
    return q.toString() + q.logical().toString() + q.executedPlan().toString()


def test_no_key_in_plans(spark):
    keys = sealed.StaticKeys("k2", NEW, {"k1": OLD})
    stored = _stored(spark, sealed.seal(_tokens(spark), keys), "plans")
    for df in (sealed.seal(_tokens(spark), keys), sealed.unseal(stored, keys), sealed.rewrapped(stored, keys)):
        text = _plans(df)
        for key in (OLD, NEW):
            for form in (key.hex(), key.hex().upper(), key.decode("latin-1"), base64.b64encode(key).decode(), ", ".join(str(b) for b in key)):
                assert form not in text
    assert NEW.hex() not in repr(keys) and repr(NEW) not in repr(keys)


def test_data_keys_differ_and_fit_their_rows(spark):
    keys = sealed.StaticKeys("k", NEW)
    stored = _stored(spark, sealed.seal(_tokens(spark, 40), keys), "differ")
    assert stored.select("wrapped_key").distinct().count() == 40
    opened = stored.select(keys.opened(F.col("key_id"), F.col("wrapped_key"))["data_key"].alias("d")).distinct().collect()
    assert len(opened) == 40 and {len(r.d) for r in opened} == {32}
    assert set(_statuses(stored, keys).values()) == {"ok"}


def test_rotation(spark):
    first, both, only = sealed.StaticKeys("k1", OLD), sealed.StaticKeys("k2", NEW, {"k1": OLD}), sealed.StaticKeys("k2", NEW)
    stored = _stored(spark, sealed.seal(_tokens(spark), first), "rotate")
    odd = stored.where("session_id = 's0'").selectExpr("'lost' AS session_id", "schema_version", "payload_version", "'k9' AS key_id", "wrapped_key", "ciphertext").unionByName(
        stored.where("session_id = 's0'").selectExpr("'null' AS session_id", "schema_version", "payload_version", "CAST(NULL AS string) AS key_id", "wrapped_key", "ciphertext"))
    stored = stored.unionByName(odd)
    assert set(_statuses(stored, only).values()) == {"unknown_key"}
    turned = _stored(spark, sealed.rewrapped(stored, both), "rotated")
    want = {f"s{i}": "ok" for i in range(6)} | {"lost": "unknown_key", "null": "unknown_key"}
    assert _statuses(turned, only) == want and turned.columns == stored.columns
    before, after = ({r.session_id: bytes(r.ciphertext) for r in d.collect()} for d in (stored, turned))
    assert before == after
    again = {r.session_id: bytes(r.wrapped_key) for r in sealed.rewrapped(turned, both).collect()}
    assert again == {r.session_id: bytes(r.wrapped_key) for r in turned.collect()}


def test_remote_keys(spark):
    keys = sealed.RemoteKeys("r2", _service(), ids=("r1",), batch=2)
    stored = _stored(spark, sealed.seal(_tokens(spark), keys).unionByName(sealed.seal(_tokens(spark).withColumn("session_id", F.concat(F.lit("old"), "session_id")), sealed.RemoteKeys("r1", _service()))), "remote")
    assert set(_statuses(stored, keys).values()) == {"ok"}
    got = _statuses(stored, sealed.RemoteKeys("r2", _service(refuses=("r1",)), ids=("r1",)))
    assert {s for i, s in got.items() if i.startswith("old")} == {"wrong_key"} and {s for i, s in got.items() if i.startswith("s")} == {"ok"}
    assert {s for i, s in _statuses(stored, sealed.RemoteKeys("r2", _service())).items() if i.startswith("old")} == {"unknown_key"}
    assert set(_statuses(stored, sealed.RemoteKeys("r2", _service(fails=("unwrap",)), ids=("r1",))).values()) == {"unavailable"}
    turned = _stored(spark, sealed.rewrapped(stored, keys), "remote_turned")
    assert {r.key_id for r in turned.collect()} == {"r2"} and set(_statuses(turned, sealed.RemoteKeys("r2", _service())).values()) == {"ok"}
    with pytest.raises(Exception, match="away"):
        sealed.seal(_tokens(spark), sealed.RemoteKeys("r2", _service(fails=("wrap",)))).collect()


def test_calls_of_a_service():
    calls = []

    def flaky(action, key_id, values):
        calls.append((action, key_id, len(values)))
        if len(calls) == 1:
            raise sealed.KeyServiceError("once")
        return list(values)

    keys = sealed.RemoteKeys("r", flaky, batch=3)
    assert keys._called("unwrap", "r", [b"a"] * 7) == [b"a"] * 7
    assert calls == [("unwrap", "r", 3), ("unwrap", "r", 3), ("unwrap", "r", 3), ("unwrap", "r", 1)]
    with pytest.raises(sealed.KeyServiceError, match="answers"):
        sealed.RemoteKeys("r", lambda a, k, v: [])._called("wrap", "r", [b"a"])
    assert "flaky" not in repr(keys)


def test_empty_table(spark):
    keys = sealed.StaticKeys("k", NEW)
    stored = _stored(spark, sealed.seal(_tokens(spark).where("false"), keys), "empty")
    assert stored.count() == 0 and _statuses(stored, keys) == {} and sealed.rewrapped(stored, keys).count() == 0
