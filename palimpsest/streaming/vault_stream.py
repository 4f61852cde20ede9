"""Streams of requests: detection and redaction row by row, and session vaults in a state store.

A session's vault is keyed state in maps: a value's token, and a counter for each family. A batch reads the entries of the values
that it meets and writes those that are new, so what goes to the store follows new values and not the vault's size. Rows of a
batch are taken in the order of their time and request; every row of a session renews its time to live, and a session that
expires begins anew.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from palimpsest.operators.detect import detect
from palimpsest.operators.rewrite import label, replacement, rewritten_spans, sanitize
from palimpsest.operators.tokens import FAMILIES, MAKERS, TokenLengthExceeded
from palimpsest.operators.vault import MAX_TOKENS
from palimpsest.sources.patterns import Pattern

TTL_MS = 3_600_000
#: How long an expired session's number of vaults is kept; a session that is back later counts its vaults from 0 again.
FORGET_MS = 7 * 86_400_000
RESULT = "session_id string, request_order long, epoch long, sanitized_text string, tokenized_count int, error string, made array<struct<matched:string,gen_key:string,seq:long,token:string>>"
#: The store that keeps maps.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Parts that rows without a session are dealt to; they have no vault.
LOOSE_PARTS = 1 << 16


def redacted_stream(requests: DataFrame, text: str = "text") -> DataFrame:
    """The stream with violations and sanitized_text; no state."""
    return sanitize(requests, text)


def _family(pattern: str) -> str:
    return FAMILIES.get(pattern) or ("phone" if pattern.endswith("_phone") else "default")


class Vaults(StatefulProcessor):
    """Tokens for the values of a session's requests. times: rows have times of their own, else the clock's count."""

    def __init__(self, ttl_ms: int, forget_ms: int, max_tokens: int, times: bool) -> None:
        self.ttl_ms, self.forget_ms, self.max_tokens, self.times = ttl_ms, forget_ms, max_tokens, times

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tokens = handle.getMapState("tokens", "matched string", "token string")
        self.counters = handle.getMapState("counters", "gen_key string", "n long")
        self.life = handle.getValueState("life", "epoch long, size long, expires long, forget long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if key[0] is None:
            for r in rows:
                yield self._answer(r, None, lambda s: (None, "token_missing"), [])
            return
        now = None if self.times else timerValues.getCurrentProcessingTimeInMs()
        epoch, size, expires, _ = self.life.get() if self.life.exists() else (0, 0, None, None)
        was, known, counted = expires, {}, {}
        for r in sorted(rows, key=lambda r: (r.at is None, r.at or 0, r.request_order is None, r.request_order or 0)):
            at = r.at if self.times else now
            if expires is not None and at is not None and at >= expires:
                self.tokens.clear()
                self.counters.clear()
                epoch, size, expires, known, counted = epoch + 1, 0, None, {}, {}
            made = []

            def token(s: dict) -> tuple[str | None, str | None]:
                nonlocal size
                value, kind = s["matched"], _family(s["pattern"])
                if value not in known:
                    known[value] = self.tokens.getValue((value,))[0] if self.tokens.containsKey((value,)) else None
                if known[value] is None:
                    if size >= self.max_tokens:
                        return None, "vault_full"
                    if kind not in counted:
                        counted[kind] = self.counters.getValue((kind,))[0] if self.counters.containsKey((kind,)) else 0
                    counted[kind] += 1
                    self.counters.updateValue((kind,), (counted[kind],))
                    try:
                        known[value] = MAKERS[kind](value, counted[kind])
                    except TokenLengthExceeded:
                        return None, "token_length_exceeded"
                    self.tokens.updateValue((value,), (known[value],))
                    size += 1
                    made.append(Row(matched=value, gen_key=kind, seq=counted[kind], token=known[value]))
                return known[value], None

            if at is not None:
                expires = at + self.ttl_ms if expires is None else max(expires, at + self.ttl_ms)
            yield self._answer(r, epoch, token, made)
        self.life.update((epoch, size, expires, None))
        if expires != was:
            if was is not None:
                self.handle.deleteTimer(was)
            self.handle.registerTimer(expires)

    def _answer(self, r: Row, epoch: int | None, token, made: list) -> Row:
        """Spans are rewritten from the text's end to its start, which is the order in which their values count."""
        raw, error, count = r.text.encode(), None, 0
        for s in reversed(json.loads(r.spans)):
            new = s["mark"]
            if not s["fixed"]:
                new, error = token(s)
                if error:
                    break
                count += 1
            raw = raw[: s["position"]] + new.encode() + raw[s["end"] :]
        return Row(session_id=r.session_id, request_order=r.request_order, epoch=epoch, sanitized_text=None if error else raw.decode(), tokenized_count=count, error=error, made=made)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """The values go at once, the number of vaults after a longer time."""
        now = expiredTimerInfo.getExpiryTimeInMs()
        epoch, _, expires, forget = self.life.get() if self.life.exists() else (0, 0, None, None)
        if expires is not None and expires <= now:
            self.tokens.clear()
            self.counters.clear()
            self.life.update((epoch + 1, 0, None, now + self.forget_ms))
            self.handle.registerTimer(now + self.forget_ms)
        elif forget is not None and forget <= now:
            self.life.clear()
        return iter(())

    def close(self) -> None:
        pass


def tokenized_stream(
    requests: DataFrame, text: str = "text", session: str = "session_id", order: str = "request_order", ttl_ms: int = TTL_MS,
    max_tokens: int = MAX_TOKENS, at: str | None = None, delay: str = "10 minutes", forget_ms: int = FORGET_MS, patterns: list[Pattern] | None = None,
) -> DataFrame:
    """RESULT for each request of a stream, or of a table (then without state between calls). made: the vault's new values.

    at: a timestamp of the requests; vaults then live by it, and the watermark, ``delay`` behind the latest time, ends those that
    nobody renews. A row that comes late is answered, too: from the vault that is there, however old the row, or from a new one
    where none is left; it never shortens a life. A row without a time renews nothing. Without ``at`` the clock counts.
    A row without a session has no vault: it is an error (token_missing) if one of its values needs a token.

    Set spark.sql.streaming.stateStore.providerClass to PROVIDER. A session's rows of one batch are in one task's memory: bound
    the batch by the source's options. Where a trigger is to end with the data there is (availableNow), set
    spark.sql.streaming.noDataMicroBatches.enabled to false: the time to live asks for further batches, and the query would go on.
    """
    if at is not None and requests.isStreaming:
        requests = requests.withWatermark(at, delay)
    if not requests.isStreaming:
        # A table's state is kept by executors that ask the driver for it; who answers starts with the session's streams.
        requests.sparkSession.streams.active  # noqa: B018
    detected = detect(requests, text, patterns)
    spans = F.transform(rewritten_spans(F.col("violations")), lambda x: F.struct(x["matched"].alias("matched"), x["pattern"].alias("pattern"), (x["type"] == "credential").alias("fixed"), x["position"].alias("position"), x["end"].alias("end"), F.when(x["type"] == "credential", label(x)).otherwise(replacement(x)).alias("mark")))
    # As a number the time has no watermark any more, and late rows are not dropped.
    time = F.lit(None).cast("long") if at is None else F.unix_millis(F.col(at).cast("timestamp"))
    part = F.when(F.col(session).isNull(), F.pmod(F.xxhash64(F.col(text), F.col(order)), F.lit(LOOSE_PARTS))).otherwise(0)
    rows = detected.select(
        F.col(session).cast("string").alias("session_id"), part.cast("long").alias("part"), F.col(order).cast("long").alias("request_order"), time.alias("at"),
        F.coalesce(F.col(text), F.lit("")).alias("text"), F.to_json(spans).alias("spans"),
    )
    mode = "ProcessingTime" if at is None else "EventTime"
    return rows.groupBy("session_id", "part").transformWithState(Vaults(ttl_ms, forget_ms, max_tokens, at is not None), StructType.fromDDL(RESULT), "append", mode)
