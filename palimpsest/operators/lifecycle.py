"""The life cycle of session vaults: renewal on use, expiry, numbers that begin anew, and the number of vaults that are live.

A vault lives from a session's first request until no request has come for the time to live; every request renews it, and at the
time of expiry itself it is gone. So a session's vaults are its runs of requests with smaller gaps, and ``epoch``, the number of
the run, is part of a vault's key: tokens of different epochs are numbered apart. That is one window by session.

How many vaults are live is a sweep over all starts and ends: a running total in order of time, made by range partitions whose
totals shift the ones behind, so no task sees all of it.

A store that holds at most so many vaults refuses sessions, and whom it refuses depends on all it did before. ``replayed`` takes a
store's calls in order of time, as a sorted stream; its state is the vaults that the store holds, never more than the maximum.
Stores are the unit that runs in parallel: sessions are dealt to stores as they are to a service's replicas.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.sources.patterns import Pattern
from palimpsest.sources.stored import stored

from .vault import MAX_TOKENS, tokenize

TTL_S = 3600
MAX_VAULTS = 10_000
#: What a call does: ``begin`` makes a vault where none is live, ``get`` only uses one, ``delete`` ends it.
ACTIONS = ("begin", "get", "delete")


def epochs(requests: DataFrame, session: str = "session_id", at: str = "at", order: str = "request_order", ttl_s: int = TTL_S) -> DataFrame:
    """requests with epoch (from 0) and expires_at. at: a timestamp; requests of the same time are in the order of ``order``.

    Requests without a session share no vault: their epoch is null. A request without a time counts as the session's first.
    """
    window = Window.partitionBy(session).orderBy(F.col(at).asc_nulls_first(), order)
    gap = F.unix_micros(at) - F.unix_micros(F.lag(at).over(window))
    marked = requests.withColumn("_new", F.when(F.lag(order).over(window).isNotNull() & (F.coalesce(gap, F.lit(0)) >= ttl_s * 1_000_000), 1).otherwise(0))
    epoch = F.sum("_new").over(window.rowsBetween(Window.unboundedPreceding, 0))
    expires = F.timestamp_micros(F.unix_micros(at) + ttl_s * 1_000_000)
    return marked.withColumns({"epoch": F.when(F.col(session).isNotNull(), epoch), "expires_at": expires}).drop("_new")


def running_total(rows: DataFrame, order: list[Column], value: str, out: str) -> DataFrame:
    """rows with the total of ``value`` up to each row in an order over the whole table.

    Rows are range-partitioned and sorted; a row's total is that of its partition so far and of the partitions before it.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = stored(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "running-total").withColumn("_part", F.shiftright("_at", 33))
    totals = spread.groupBy("_part").agg(F.sum(value).alias("_sum"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    shifts = totals.select(F.col("_part").alias("_of"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    met = spread.withColumn("_in", F.sum(value).over(inside)).join(shifts, F.col("_part") == F.col("_of"))
    return met.withColumn(out, F.col("_in") + F.col("_shift")).drop("_at", "_part", "_of", "_in", "_shift")


def vaults(requests: DataFrame, session: str = "session_id", at: str = "at", order: str = "request_order", ttl_s: int = TTL_S) -> DataFrame:
    """A row for each vault: session_id, epoch, started_at, expires_at, requests, live (vaults when it started, itself included)."""
    made = epochs(requests, session, at, order, ttl_s).where(F.col(session).isNotNull())
    own = made.groupBy(F.col(session).alias("session_id"), "epoch").agg(F.min(at).alias("started_at"), F.max("expires_at").alias("expires_at"), F.count("*").alias("requests"))
    points = own.select("*", F.explode(F.array(F.struct(F.col("started_at").alias("time"), F.lit(1).alias("step")), F.struct(F.col("expires_at").alias("time"), F.lit(-1).alias("step")))).alias("p")).select("*", "p.*").drop("p")
    # What expires at a time is gone for whatever starts at it.
    swept = running_total(points, [F.col("time").asc_nulls_first(), F.col("step"), F.col("session_id"), F.col("epoch")], "step", "live")
    return swept.where("step = 1").select("session_id", "epoch", "started_at", "expires_at", "requests", "live")


def tokenize_with_expiry(df: DataFrame, text: str = "text", session: str = "session_id", at: str = "at", order: str = "request_order", ttl_s: int = TTL_S, patterns: list[Pattern] | None = None, max_tokens: int = MAX_TOKENS) -> tuple[DataFrame, DataFrame]:
    """vault.tokenize with a vault for each epoch: (df with epoch, expires_at and its columns; the vaults' tokens with epoch)."""
    key = F.when(F.col("epoch").isNotNull(), F.concat_ws("#", session, F.col("epoch").cast("string")))
    keyed = epochs(df, session, at, order, ttl_s).withColumn("_vault", key)
    out, tokens = tokenize(keyed, text, "_vault", order, patterns, max_tokens)
    epoch = F.substring_index("session_id", "#", -1).cast("long")
    name = F.expr("left(session_id, length(session_id) - length(substring_index(session_id, '#', -1)) - 1)")
    return out.drop("_vault"), tokens.withColumn("epoch", epoch).withColumn("session_id", name)


_REPLAYED = pa.schema([("store", pa.string()), ("session_id", pa.string()), ("at", pa.int64()), ("request_order", pa.int64()), ("action", pa.string()), ("epoch", pa.int64()), ("status", pa.string())])


class Store:
    """The vaults that one store holds: session -> (expiry, epoch), and a heap of expiries, some of them out of date."""

    def __init__(self, ttl: int, most: int):
        self.ttl, self.most, self.held, self.ends = ttl, most, {}, []
        self.made: dict[str, int] = {}

    def swept(self, now: int) -> None:
        while self.ends and self.ends[0][0] <= now:
            end, session = heapq.heappop(self.ends)
            if self.held.get(session, (None,))[0] == end:
                del self.held[session]

    def renewed(self, session: str, now: int, epoch: int) -> int:
        self.held[session] = (now + self.ttl, epoch)
        heapq.heappush(self.ends, (now + self.ttl, session))
        return epoch

    def call(self, action: str, session: str, now: int) -> tuple[int | None, str]:
        """(epoch, status) of one call."""
        old = self.held.get(session)
        gone = old is not None and old[0] <= now
        if action == "delete":
            self.held.pop(session, None)
            return None, "ok"
        if old is not None and not gone:
            return self.renewed(session, now, old[1]), "ok"
        self.held.pop(session, None)
        if action == "get":
            return None, "session_expired" if gone else "vault_not_found"
        if len(self.held) >= self.most:
            self.swept(now)
            if len(self.held) >= self.most:
                return None, "vault_full"
        # Only the number of a session's vaults outlives them.
        self.made[session] = self.made.get(session, -1) + 1
        return self.renewed(session, now, self.made[session]), "ok"


def _replay(batches: Iterator[pa.RecordBatch], ttl: int, most: int) -> Iterator[pa.RecordBatch]:
    """(store, session, at, order, action), sorted by store and time."""
    store, last = Store(ttl, most), None
    for b in batches:
        found = []
        for name, session, now, action in zip(*(b.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
            if name != last:
                store, last = Store(ttl, most), name
            found.append(store.call(action, session, now))
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([e for e, _ in found], pa.int64()), pa.array([s for _, s in found], pa.string())], schema=_REPLAYED)


def replayed(calls: DataFrame, store: str = "store", session: str = "session_id", at: str = "at", order: str = "request_order", action: str = "action", ttl_s: int = TTL_S, max_vaults: int = MAX_VAULTS) -> DataFrame:
    """store, session_id, at, request_order, action, epoch, status of every call with a session and a time.

    status: ok; vault_full (no room for a new vault, also after those that expired were removed); vault_not_found and
    session_expired (get without a live vault). Calls of one time are in the order of session and ``order``.
    """
    rows = calls.where(F.col(session).isNotNull() & F.col(at).isNotNull()).select(
        F.coalesce(F.col(store).cast("string"), F.lit("")).alias("store"), F.col(session).cast("string").alias("session_id"), F.unix_micros(at).alias("at"), F.col(order).cast("long").alias("request_order"), F.col(action).alias("action"),
    )
    sorted_ = rows.repartition("store").sortWithinPartitions("store", "at", "session_id", "request_order")
    out = sorted_.mapInArrow(partial(_replay, ttl=ttl_s * 1_000_000, most=max_vaults), "store string, session_id string, at long, request_order long, action string, epoch long, status string")
    return out.withColumn("at", F.timestamp_micros("at"))
