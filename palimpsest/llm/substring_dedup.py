"""Substring dedup: words covered by a window of 50 words that also starts in a document with a smaller id are removed.

Super-k-mer partitioning. Every window has a minimiser, the least hash among its runs of MINIMISER words. Consecutive windows
with the same minimiser form a super-k-mer, and equal windows have equal minimisers. A first pass counts which minimisers stand
in more than one document; windows of any other minimiser can't repeat, so only the rest travels: each super-k-mer as one
packed string of its words. Equal strings are reduced to the least document that has them before they reach the bucket of their
minimiser. In a bucket the windows of all strings are sorted with their documents, which finds for each window the least
document it starts in. The strings' results go back to the places they came from; a place whose document is larger than the
window's least document marks its words.

Words are compared as their UTF-8 bytes; hashes only choose buckets, and never decide.

Rules for odd rows: a null text has no words; windows lie within one text; rows with the same id are the same document, so
they don't remove each other's windows, but each loses what a smaller id has; null is the largest id; wholly equal rows get
equal results; texts shorter than a window lose nothing; an empty table gives an empty result; further columns are ignored or
pass through, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import row_key, table, written

WINDOW = 50
#: Words of the runs that minimisers are chosen from.
MINIMISER = 4
#: Most windows in one super-k-mer; longer runs of one minimiser are several.
LONGEST = 256

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: An odd multiplier and its inverse modulo 2^64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_kept_powers: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 to base^(n-1) modulo 2^64."""
    if len(_kept_powers.get(base, ())) < n:
        powers = np.full(n, base, np.uint64)
        powers[0] = 1
        _kept_powers[base] = np.multiply.accumulate(powers)
    return _kept_powers[base][:n]


class Words:
    """The words of a batch of texts: where each begins and ends in the batch's bytes, its hash, and each text's first word."""

    def __init__(self, texts: list[bytes]):
        self.data = b"\n".join(texts) + b"\n"
        raw = np.frombuffer(self.data, np.uint8)
        space = _SPACE[raw]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
        self.begin, self.end = edge[0::2], edge[1::2]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.first = np.searchsorted(self.begin, np.concatenate(([0], np.cumsum(lengths))))
        # A polynomial in the word's bytes: differences of a running sum of byte * power, divided by the power at the start.
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(raw)), out=sums[1:])
        self.hash = _mixed((sums[self.end] - sums[self.begin]) * _powers(_INVERSE, len(raw))[self.begin])

    def super_kmers(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, first word, windows, minimiser) of every super-k-mer."""
        empty = np.empty(0, np.int64)
        n = len(self.hash) - WINDOW + 1
        if n < 1:
            return empty, empty, empty, empty.astype(np.uint64)
        runs = np.zeros(len(self.hash) - MINIMISER + 1, np.uint64)
        for k in range(MINIMISER):
            runs = runs * np.uint64(0x100000001B3) + self.hash[k : len(runs) + k]
        least, width, need = _mixed(runs), 1, WINDOW - MINIMISER + 1
        while 2 * width <= need:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < need:
            least = np.minimum(least[: width - need], least[need - width :])
        text = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        inside = text[:n] == text[WINDOW - 1 :]
        start = inside.copy()
        start[1:] &= (least[1:] != least[:-1]) | ~inside[:-1] | (text[1:n] != text[: n - 1])
        begin = np.flatnonzero(start)
        # A run of windows ends where the next begins or its text's windows end.
        stop = np.minimum(np.append(begin[1:], n), self.first[1:][text[begin]] - WINDOW + 1)
        pieces = -(-(stop - begin) // LONGEST)
        part = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        at = np.repeat(begin, pieces) + part * LONGEST
        return text[at], at, np.minimum(np.repeat(stop, pieces) - at, LONGEST), least[at]

    def packed(self, word: int, windows: int) -> bytes:
        """The words of a super-k-mer, a space between them."""
        return b" ".join(self.data[self.begin[word] : self.end[word + windows + WINDOW - 2]].split())


def _batches(batch: pa.RecordBatch, column: int, most: int = 2 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) of parts of a batch with about ``most`` bytes."""
    part, at, size = [], 0, 0
    for i, t in enumerate(batch.column(column)):
        raw = (t.as_py() or "").encode()
        part.append(raw)
        size += len(raw)
        if size >= most:
            yield at, part
            part, at, size = [], i + 1, 0
    if part:
        yield at, part


def _minimisers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, row_key, text) -> a row for each text and each of its minimisers."""
    for b in batches:
        for at, texts in _batches(b, 2):
            text, _, _, least = Words(texts).super_kmers()
            order = np.lexsort((least, text))
            text, least = text[order], least[order]
            fresh = np.concatenate(([True], (text[1:] != text[:-1]) | (least[1:] != least[:-1]))) if len(text) else np.empty(0, bool)
            rows = pa.array(text[fresh] + at)
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(least[fresh].view(np.int64))], ["id", "row_key", "h"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, row_key, text, hs) -> the super-k-mers of minimisers in hs: id, row_key, first word, h, packed words."""
    for b in batches:
        for at, texts in _batches(b, 2):
            words = Words(texts)
            text, word, windows, least = words.super_kmers()
            wanted = np.unique(np.concatenate([np.asarray(h or [], np.int64) for h in b.column(3).slice(at, len(texts)).to_pylist()]))
            keep = np.flatnonzero(np.isin(least.view(np.int64), wanted))
            for lo in range(0, len(keep), 20000):
                k = keep[lo : lo + 20000]
                rows = pa.array(text[k] + at)
                strings = [words.packed(w, n) for w, n in zip(word[k].tolist(), windows[k].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(rows), b.column(1).take(rows), pa.array(word[k] - words.first[text[k]]), pa.array(least[k].view(np.int64)), pa.array(strings, pa.binary())],
                    ["id", "row_key", "at", "h", "packed"],
                )


def _windows(packed: bytes) -> list[bytes]:
    ends = np.append(np.flatnonzero(np.frombuffer(packed, np.uint8) == 32), len(packed)).tolist()
    starts = [0] + [e + 1 for e in ends[: len(ends) - WINDOW]]
    return [packed[s:e] for s, e in zip(starts, ends[WINDOW - 1 :], strict=True)]


def _bucket(rows: list[tuple[int, bytes, int]]) -> Iterator[tuple[int, bytes, list[int], list[int], list[int]]]:
    """(h, packed, least id with it) of one minimiser -> (h, packed, from, to, owner): runs of windows and their least id."""
    if len(rows) == 1:
        h, packed, least = rows[0]
        yield h, packed, [0], [packed.count(b" ") - WINDOW + 2], [least]
        return
    windows = [_windows(packed) for _, packed, _ in rows]
    order = sorted((w, r, i) for r, ws in enumerate(windows) for i, w in enumerate(ws))
    owners = [[0] * len(ws) for ws in windows]
    for _, same in groupby(order, key=lambda x: x[0]):
        places = list(same)
        least = min(rows[r][2] for _, r, _ in places)
        for _, r, i in places:
            owners[r][i] = least
    for (h, packed, _), own in zip(rows, owners, strict=True):
        begin, end, who = [], [], []
        for i, o in enumerate(own):
            if who and who[-1] == o:
                end[-1] = i + 1
            else:
                begin.append(i)
                end.append(i + 1)
                who.append(o)
        yield h, packed, begin, end, who


def _owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct strings, sorted by minimiser -> each string's runs of windows with their least document."""
    schema = pa.schema([("h", pa.int64()), ("key", pa.binary()), ("begin", pa.list_(pa.int64())), ("end", pa.list_(pa.int64())), ("owner", pa.list_(pa.int64()))])
    out: list = []

    def batch() -> pa.RecordBatch:
        arrays = [pa.array([x[i] for x in out], schema.field(i).type) for i in range(5)]
        out.clear()
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    def rows() -> Iterator[tuple[int, bytes, int]]:
        for b in batches:
            yield from zip(*(b.column(i).to_pylist() for i in range(3)), strict=True)

    for _, group in groupby(rows(), key=lambda r: r[0]):
        for h, packed, begin, end, who in _bucket(list(group)):
            out.append((h, hashlib.sha256(packed).digest(), begin, end, who))
        if len(out) >= 5000:
            yield batch()
    yield batch()


def removed_runs(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """id, row_key, runs (from, to; words, end exclusive, sorted, may touch) of the rows that lose words."""
    base = docs.select(F.col(id_column).cast("long").alias("id"), row_key(id_column).alias("row_key"), F.col("text").alias("text"))
    found = base.mapInArrow(_minimisers, "id long, row_key long, h long")
    minimisers = written(found.select(F.coalesce("id", F.lit(2**63 - 1)).alias("id"), "row_key", "h"), "minimisers")
    shared = minimisers.groupBy("h").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("h")
    wanted = minimisers.join(shared, "h", "left_semi").groupBy("id", "row_key").agg(F.collect_set("h").alias("hs"))
    texts = base.select(F.coalesce("id", F.lit(2**63 - 1)).alias("id"), "row_key", "text")
    places = texts.join(wanted, ["id", "row_key"]).select("id", "row_key", "text", "hs")
    packed = written(places.mapInArrow(_packed, "id long, row_key long, at long, h long, packed binary"), "super-kmers")
    strings = packed.groupBy("h", "packed").agg(F.min("id").alias("least"))
    owners = strings.repartition("h").sortWithinPartitions("h").mapInArrow(_owners, "h long, key binary, begin array<long>, end array<long>, owner array<long>")
    met = packed.select("id", "row_key", "at", "h", F.unhex(F.sha2("packed", 256)).alias("key")).join(owners, ["h", "key"])
    runs = met.select("id", "row_key", "at", F.explode(F.arrays_zip("begin", "end", "owner")).alias("r")).where("r.owner < id")
    words = runs.groupBy("id", "row_key").agg(F.array_sort(F.collect_set(F.struct((F.col("at") + F.col("r.begin")).alias("begin"), (F.col("at") + F.col("r.end") + WINDOW - 1).alias("end")))).alias("runs"))
    return words


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, runs) -> id, n_words, n_removed, kept words."""
    for b in batches:
        counts, gone, kept = [], [], []
        for t, runs in zip(b.column(1), b.column(2).to_pylist(), strict=True):
            words = (t.as_py() or "").encode().split()
            left, at = [], 0
            for r in runs or []:
                left += words[at : r["begin"]]
                at = max(at, r["end"])
            left += words[at:]
            counts.append(len(words))
            gone.append(len(words) - len(left))
            kept.append(b" ".join(left).decode())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["id", "n_words", "n_removed", "kept_words"])


def dedup_substrings(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """id, n_words, n_removed, kept_words of every row of docs."""
    runs = removed_runs(docs, id_column)
    base = docs.select(F.col(id_column).cast("long").alias("id"), row_key(id_column).alias("r_key"), F.col("text").alias("text"))
    met = base.join(runs, (base["r_key"] == runs["row_key"]) & (F.coalesce(base["id"], F.lit(2**63 - 1)) == runs["id"]), "left")
    return met.select(base["id"], "text", "runs").mapInArrow(_kept, "id long, n_words long, n_removed long, kept_words string")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept_words", 256).alias("kept_sha256"))


def queries() -> dict:
    return {"op5_substring_dedup": op5_substring_dedup}


ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, t, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS win FROM (SELECT *, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM d WHERE len(words) >= {WINDOW})),
r AS (SELECT doc_id, t, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY win) AS least FROM w) WHERE least < doc_id),
g AS (SELECT doc_id, t, list(DISTINCT j) AS gone FROM (SELECT doc_id, t, unnest(range(i, i + {WINDOW})) AS j FROM r) GROUP BY ALL),
k AS (
  SELECT d.doc_id, len(words) AS n, coalesce(len(gone), 0) AS n_gone, list_filter(words, lambda x, i: gone IS NULL OR NOT list_contains(gone, i)) AS kept
  FROM d LEFT JOIN g ON d.doc_id = g.doc_id AND d.t = g.t)
SELECT doc_id, n::BIGINT AS n_words, n_gone::BIGINT AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM k
"""


def oracle_sql() -> dict:
    return {"op5_substring_dedup": ORACLE}
