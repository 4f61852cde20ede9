"""Encrypted vault rows: a data key for every save, wrapped by a master key, with versions that writers compare.

Keys never stand in a plan: a provider's keys travel in the closure of a function over columns, which plans, the UI and event logs
show by its name alone. Data keys are drawn in the tasks from the system's random source. A task that runs again draws others, but
a row's wrapped key and ciphertext come from the same task, so they always fit each other.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCHEMA_VERSION = 1
_GCM = "GCM"


class KeyProvider(Protocol):
    """Where master keys are. What wrapping and unwrapping take and give are columns."""

    def key_id(self) -> str:
        """The id of the key that wraps."""

    def wrapped(self, data_key: Column) -> Column:
        """binary: the data key under the current master key."""

    def opened(self, key_id: Column, wrapped: Column) -> Column:
        """struct<data_key binary, failure string>: failure is null, unknown_key, wrong_key or unavailable."""


@dataclass(frozen=True)
class StaticKeys:
    """A current master key and older ones that still open what they sealed."""

    current: str
    key: bytes = field(repr=False)
    fallback: Mapping[str, bytes] = field(default_factory=dict, repr=False)

    def __post_init__(self) -> None:
        if any(len(k) != 32 for k in (self.key, *self.fallback.values())):
            raise ValueError("a master key has 32 bytes")

    def key_id(self) -> str:
        return self.current

    def _master(self, key_id: Column) -> Column:
        keys = {**self.fallback, self.current: self.key}

        @F.pandas_udf("binary")
        def master_key(ids: pd.Series) -> pd.Series:
            return ids.map(keys.get)

        return master_key(key_id)

    def wrapped(self, data_key: Column) -> Column:
        return F.aes_encrypt(data_key, self._master(F.lit(self.current)), F.lit(_GCM))

    def opened(self, key_id: Column, wrapped: Column) -> Column:
        found = F.try_aes_decrypt(wrapped, self._master(key_id), F.lit(_GCM))
        known = F.coalesce(key_id.isin(self.current, *self.fallback), F.lit(False))
        return F.struct(F.when(known, found).alias("data_key"), F.when(~known, "unknown_key").when(found.isNull(), "wrong_key").alias("failure"))


class KeyServiceError(Exception):
    """What a transport raises for one whole call: the service can't be reached, or refuses the caller."""


#: (action: wrap or unwrap, key id, values as base64) to values as base64, None for each that the key doesn't open.
Transport = Callable[[str, str, Sequence[str]], Sequence[str | None]]


@dataclass(frozen=True)
class RemoteKeys:
    """Master keys that never leave a service: a transport, run in the tasks, hands it what is to be wrapped or unwrapped.

    A call takes up to ``batch`` values of one key; unwrapping asks once for each different wrapped key of an Arrow batch, and once
    more for each failed call. ids: the keys that may be asked for; others are unknown and are never sent.
    """

    current: str
    transport: Transport = field(repr=False)
    ids: tuple[str, ...] = ()
    batch: int = 256
    attempts: int = 2

    def key_id(self) -> str:
        return self.current

    def _called(self, action: str, key_id: str, values: Sequence[bytes]) -> list[bytes | None]:
        out: list[bytes | None] = []
        for at in range(0, len(values), self.batch):
            part = [base64.b64encode(v).decode() for v in values[at : at + self.batch]]
            for left in reversed(range(self.attempts)):
                try:
                    answers = list(self.transport(action, key_id, part))
                    break
                except KeyServiceError:
                    if not left:
                        raise
            if len(answers) != len(part):
                raise KeyServiceError(f"{len(answers)} answers to {len(part)} values")
            out += [None if a is None else base64.b64decode(a) for a in answers]
        return out

    def wrapped(self, data_key: Column) -> Column:
        """A service that stays away fails the save: nothing may be stored that can't be opened."""

        @F.pandas_udf("binary")
        def wrapped_key(keys: pd.Series) -> pd.Series:
            answers = self._called("wrap", self.current, [k for k in keys if k is not None])
            if None in answers:
                raise KeyServiceError("a value was not wrapped")
            left = iter(answers)
            return pd.Series([None if k is None else next(left) for k in keys], dtype=object)

        return wrapped_key(data_key)

    def opened(self, key_id: Column, wrapped: Column) -> Column:
        """A service that stays away makes rows unavailable, which keeps them."""
        known = {self.current, *self.ids}

        @F.pandas_udf("data_key binary, failure string")
        def opened_key(ids: pd.Series, values: pd.Series) -> pd.DataFrame:
            found: dict[tuple[str | None, bytes | None], tuple[bytes | None, str | None]] = {}
            asked: dict[str, dict[bytes, None]] = {}
            for k, v in zip(ids, values):
                if k not in known:
                    found[k, v] = (None, "unknown_key")
                elif v is None:
                    found[k, v] = (None, "wrong_key")
                else:
                    asked.setdefault(k, {})[v] = None
            for k, distinct in asked.items():
                try:
                    answers = self._called("unwrap", k, list(distinct))
                    found |= {(k, v): (a, "wrong_key" if a is None else None) for v, a in zip(distinct, answers)}
                except KeyServiceError:
                    found |= {(k, v): (None, "unavailable") for v in distinct}
            return pd.DataFrame([found[k, v] for k, v in zip(ids, values)], columns=["data_key", "failure"])

        return opened_key(key_id, wrapped)


def _new_key(row: Column) -> Column:
    @F.pandas_udf("binary")
    def new_data_key(rows: pd.Series) -> pd.Series:
        return pd.Series([os.urandom(32) for _ in range(len(rows))], dtype=object)

    return new_data_key.asNondeterministic()(row)


def seal(tokens: DataFrame, provider: KeyProvider, version: int = 1) -> DataFrame:
    """A row for each session: session_id, schema_version, payload_version, key_id, wrapped_key, ciphertext (AES-256-GCM)."""
    state = tokens.where("token IS NOT NULL").groupBy("session_id").agg(F.to_json(F.sort_array(F.collect_list(F.struct("ord", "matched", "token", "gen_key", "seq")))).alias("state"))
    keyed = state.withColumn("data_key", _new_key(F.col("session_id")))
    return keyed.select(
        "session_id", F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(version).cast("long").alias("payload_version"), F.lit(provider.key_id()).alias("key_id"),
        provider.wrapped(F.col("data_key")).alias("wrapped_key"), F.aes_encrypt(F.col("state").cast("binary"), F.col("data_key"), F.lit(_GCM)).alias("ciphertext"),
    )


def unseal(sealed: DataFrame, provider: KeyProvider) -> DataFrame:
    """session_id, payload_version, state (JSON) and status: ok; unknown_key, wrong_key or unavailable (the row is to be kept, its
    key may come back); corrupt (to be deleted: another schema, or what the right key doesn't open)."""
    opened = sealed.withColumn("_key", provider.opened(F.col("key_id"), F.col("wrapped_key")))
    state = F.when(F.col("_key.data_key").isNotNull(), F.try_aes_decrypt("ciphertext", F.col("_key.data_key"), F.lit(_GCM))).cast("string")
    read = opened.withColumn("state", state)
    status = (
        F.when(~F.col("schema_version").eqNullSafe(SCHEMA_VERSION), "corrupt").when(F.col("_key.failure").isNotNull(), F.col("_key.failure"))
        .when(F.col("state").isNull() | F.try_parse_json("state").isNull(), "corrupt").otherwise("ok")
    )
    return read.select("session_id", "payload_version", F.when(status == "ok", F.col("state")).alias("state"), status.alias("status"))


def rewrapped(sealed: DataFrame, provider: KeyProvider) -> DataFrame:
    """The rows with data keys under the provider's current key, where they are under an older one that opens; ciphertexts stay.

    After this the older keys may go. Rows whose key is unknown, wrong or unavailable are as they were.
    """
    older = F.when(F.col("key_id") != provider.key_id(), F.col("key_id"))
    opened = sealed.withColumn("_key", provider.opened(older, F.col("wrapped_key"))).withColumn("_data", F.col("_key.data_key"))
    new = F.col("_data").isNotNull()
    return opened.withColumns({
        "wrapped_key": F.coalesce(provider.wrapped(F.col("_data")), F.col("wrapped_key")), "key_id": F.when(new, F.lit(provider.key_id())).otherwise(F.col("key_id")),
    }).select(*sealed.columns)


def merged(stored: DataFrame, saves: DataFrame) -> DataFrame:
    """The table after saves that state the version they read (base_version): a save holds only if nobody saved in between."""
    old = stored.select(F.col("session_id").alias("_s"), F.col("payload_version").alias("_v"))
    one = saves.withColumn("_n", F.row_number().over(Window.partitionBy("session_id").orderBy("base_version"))).where("_n = 1").drop("_n")
    fresh = one.join(old, one["session_id"] == old["_s"], "left").where(F.coalesce("_v", F.lit(0).cast("long")) == F.col("base_version"))
    new = fresh.withColumn("payload_version", F.col("base_version") + 1).select(*stored.columns)
    return stored.join(new.select("session_id"), "session_id", "left_anti").unionByName(new)
