"""Spans of a contextual token classifier: scoring in Arrow batches, decoding of tags, and mapping to violations."""

from __future__ import annotations

import functools
import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import SPANS, span

MODEL_SPAN = "struct<label:string,text:string,start:int,end:int,score:double>"
MAX_BYTES = 16384
BATCH = 32
#: Tokens that are Python objects at once, but for a text that has more of them by itself.
SLICE_TOKENS = 1 << 14
#: Type, severity and pattern of each label.
LABELS = {
    "private_bvn": ("pii", "BLOCK", "slm_bvn"), "private_nin": ("pii", "BLOCK", "slm_nin"), "private_passport_number": ("pii", "BLOCK", "slm_passport"),
    "private_drivers_license_number": ("pii", "BLOCK", "slm_drivers_license"), "private_voters_card_number": ("pii", "BLOCK", "slm_voters_card"),
    "account_number": ("financial", "BLOCK", "slm_account_number"), "secret": ("credential", "BLOCK", "slm_secret"),
    "private_email": ("pii", "WARN", "slm_email"), "private_phone": ("pii", "WARN", "slm_phone"), "private_person": ("pii", "WARN", "slm_person"),
    "private_address": ("pii", "WARN", "slm_address"), "private_url": ("pii", "LOG", "slm_url"), "private_date": ("pii", "LOG", "slm_date"),
}


class Scorer(Protocol):
    """Tags for texts: for each the tokens' (char_start, char_end, mask, label, score)."""

    def __call__(self, texts: list[str]) -> list[list[tuple[int, int, int, str, float]]]: ...


TOKEN = "struct<start:int,end:int,mask:int,tag:string,score:double>"
#: Tags that begin a span, and tags that end one.
BEGINS, ENDS = list("BSU"), list("SUEL")


def islands(tokens: pd.DataFrame) -> pd.DataFrame:
    """row, label, start, end, score of spans in characters, from tagged tokens (row, nth, start, end, mask, tag, score) in order.

    A span is an island of tokens: a token begins one if its tag says so, if the token before it ended one or is in none, or if
    the labels differ. The running sum of the begins numbers the islands. A tag with no known prefix begins a span, and a token
    but the first that stands for no text is in none.
    """
    seen = tokens[tokens["mask"] != 0].reset_index(drop=True)
    parts = seen["tag"].fillna("").str.extract(r"\A([BIOESLU])-(.+)\Z", flags=re.DOTALL)
    bare = parts[0].isna()
    prefix = parts[0].where(~bare, "B")
    label = parts[1].where(~bare, seen["tag"])
    outside = (prefix == "O") | seen["tag"].isna() | seen["tag"].isin(["", "O"]) | ((seen["nth"] > 0) & (seen["start"] == 0) & (seen["end"] == 0))
    open_ = ~outside & ~prefix.isin(ENDS)
    goes_on = open_.shift(fill_value=False) & (label == label.shift()) & (seen["row"] == seen["row"].shift()) & ~prefix.isin(BEGINS)
    inside = seen.assign(label=label, island=(~goes_on).cumsum())[~outside]
    spans = inside.groupby("island").agg(row=("row", "first"), label=("label", "first"), start=("start", "first"), end=("end", "last"), score=("score", "mean"))
    return spans.reset_index(drop=True)


def joined(spans: pd.DataFrame, texts: list[str]) -> pd.DataFrame:
    """Spans without the white space at their edges, blank ones left out; neighbours of a label with only white space between
    become one, numbered by a second running sum. A joined span's score halves what came before with each span that joins."""
    pieces = [texts[r][s:e] for r, s, e in zip(spans["row"], spans["start"], spans["end"], strict=True)]
    left = pd.Series([len(p) - len(p.lstrip()) for p in pieces], index=spans.index, dtype="int64")
    right = pd.Series([len(p.rstrip()) for p in pieces], index=spans.index, dtype="int64")
    spans = spans.sort_values(["row", "start", "end"], kind="stable").assign(end=spans["start"] + right, start=spans["start"] + left)
    spans = spans[spans["start"] < spans["end"]]
    before = spans.shift()
    near = (spans["row"] == before["row"]) & (spans["label"] == before["label"])
    blank = [n and not texts[int(r)][int(e) : s].strip() for n, r, e, s in zip(near, spans["row"], before["end"], spans["start"], strict=True)]
    group = (~pd.Series(blank, index=spans.index, dtype=bool)).cumsum()
    halved = lambda s: functools.reduce(lambda a, b: (a + b) / 2, s)
    return spans.groupby(group).agg(row=("row", "first"), label=("label", "first"), start=("start", "first"), end=("end", "last"), score=("score", halved))


def in_bytes(text: str, spans: list[tuple[str, int, int, float]]) -> list[dict]:
    """Spans by position in characters -> in bytes, with their text; each stretch of the text is measured once."""
    out, at, size = [], 0, 0
    for label, start, end, score_ in spans:
        size = size + len(text[at:start].encode()) if start >= at else len(text[:start].encode())
        piece = text[start:end]
        length = len(piece.encode())
        out.append({"label": label, "text": piece, "start": size, "end": size + length, "score": score_})
        at, size = end, size + length
    return out


def _decoded(text: pd.Series, tokens: pd.Series) -> pd.Series:
    fields = ["start", "end", "mask", "tag", "score"]
    rows = [(r, i, *(t[f] for f in fields)) for r, (x, own) in enumerate(zip(text, tokens, strict=True)) if x is not None and own is not None for i, t in enumerate(own)]
    out: list = [None if x is None or own is None else [] for x, own in zip(text, tokens, strict=True)]
    if rows:
        spans = joined(islands(pd.DataFrame(rows, columns=["row", "nth", *fields])), list(text))
        for row, own in spans.groupby("row"):
            out[int(row)] = in_bytes(text.iloc[int(row)], list(own[["label", "start", "end", "score"]].itertuples(index=False, name=None)))
    return pd.Series(out)


_SPANS = pa.list_(pa.struct([("label", pa.string()), ("text", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def _sliced(text: pa.Array, tokens: pa.Array) -> pa.Array:
    """_decoded for an Arrow batch, slice by slice: a batch may hold many tokens, and as Python objects they take many times their bytes."""
    before = np.concatenate([[0], np.cumsum(tokens.value_lengths().fill_null(0).to_numpy())])
    out, at = [], 0
    while at < len(tokens):
        stop = max(at + 1, int(np.searchsorted(before, before[at] + SLICE_TOKENS, side="right")) - 1)
        stop = min(stop, at + SLICE_TOKENS)
        out.append(pa.array(_decoded(text[at:stop].to_pandas(), tokens[at:stop].to_pandas()).tolist(), _SPANS))
        at = stop
    return pa.concat_arrays(out) if out else pa.array([], _SPANS)


def decoded(text: Column | str, tokens: Column | str) -> Column:
    """A text and its tagged tokens (array<TOKEN>, in characters) -> its spans in bytes; null where either is null."""
    return F.arrow_udf(_sliced, f"array<{MODEL_SPAN}>")(text, tokens)


class Breaker:
    """Opens after a number of failures in a row and lets one call through after a while."""

    def __init__(self, failures: int = 5, cooldown_s: float = 30.0, clock: Callable[[], float] = time.monotonic):
        self.failures, self.cooldown, self.clock, self.count, self.opened = failures, cooldown_s, clock, 0, None

    def allows(self) -> bool:
        return self.opened is None or self.clock() - self.opened >= self.cooldown

    def record(self, ok: bool) -> None:
        self.count = 0 if ok else self.count + 1
        self.opened = None if ok else self.clock() if self.count >= self.failures else self.opened


def score(df: DataFrame, scorer: Callable[[], Scorer], text: str = "text", enabled: str | None = None, default: bool = True, max_bytes: int = MAX_BYTES, batch: int = BATCH) -> DataFrame:
    """df with model_spans (bytes). Texts that are too long, or whose row says no, aren't scored; a scorer that fails gives no
    spans. Each task has a scorer and a breaker of its own."""

    @F.pandas_udf(f"array<{TOKEN}>")
    def tagged(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model, breaker = scorer(), Breaker()
        for texts in parts:
            out: list[list[dict]] = [[] for _ in range(len(texts))]
            wanted = [i for i, t in enumerate(texts) if t]
            for at in range(0, len(wanted), batch):
                rows = wanted[at : at + batch]
                if not breaker.allows():
                    continue
                try:
                    found = model([texts.iloc[i] for i in rows])
                    breaker.record(True)
                except Exception:  # noqa: BLE001  any failure of a model only loses its spans
                    breaker.record(False)
                    continue
                for i, tokens in zip(rows, found, strict=True):
                    out[i] = [dict(zip(("start", "end", "mask", "tag", "score"), t, strict=True)) for t in tokens]
            yield pd.Series(out)

    ask = F.octet_length(text) <= max_bytes
    if enabled:
        ask &= F.coalesce(F.col(enabled), F.lit(default))
    tokens = tagged(F.when(ask, F.col(text)))
    return df.withColumn("model_spans", F.coalesce(decoded(F.col(text), tokens), F.array().cast(f"array<{MODEL_SPAN}>")))


def label_table(overrides: dict[str, tuple[str, str, str]] | None = None) -> dict[str, tuple[str, str, str]]:
    """LABELS with overrides; an empty field keeps the default."""
    table = dict(LABELS)
    for name, new in (overrides or {}).items():
        old = table.get(name, ("", "", ""))
        table[name] = tuple(n or o for n, o in zip(new, old))
    return table


def model_violations(spans: Column, overrides: dict[str, tuple[str, str, str]] | None = None) -> Column:
    """Violations of known labels; others are dropped."""
    table = label_table(overrides)
    known = F.filter(spans, lambda s: s["label"].isin(*table))
    pick = lambda s, i: F.element_at(F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, v[i])]), s["label"])
    return F.transform(known, lambda s: span(pick(s, 0), pick(s, 1), pick(s, 2), s["text"], s["start"], s["end"])).cast(SPANS)
