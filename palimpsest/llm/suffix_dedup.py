"""Suffix-array dedup: bytes covered by a 400-byte string that also starts anywhere else are removed.

1. Anchors. Every window of WINDOW bytes has an anchor, the run of ANCHOR bytes in it with the least hash, so equal windows have
   equal anchors. Consecutive windows with the same anchor form a region, kept as its place, its anchor's hash and a digest of its
   bytes. A window whose anchor occurs once can't repeat, and a region that occurs twice repeats whole; neither needs its bytes.
2. Shards. What is left, one copy of each different region of an anchor that has several, is cut from the texts and dealt out by
   anchor. A task joins whole anchors to shards of about SHARD_BYTES and builds each one's suffix array: suffixes are ordered by
   their first bytes and Larsson-Sadakane refinement doubles the compared length, sorting only groups that are still tied, until
   WINDOW bytes are compared. Kasai's lemma gives the common prefixes of neighbours: only where a suffix's predecessor is not the
   successor of the predecessor before are bytes compared, all others follow by subtraction. A window repeats if it shares WINDOW
   bytes with a neighbour.
3. Cross-shard merging. An anchor with more than PART_BYTES of different regions is dealt to several shards. Each of those returns
   its different windows as sorted arrays of 128-bit digests (BLAKE2), cut into slices by value; a slice's arrays are merged two by
   two by binary search, which finds the windows that stand in more than one shard. So a passage that a third of all rows share in
   different surroundings is neither one task nor a comparison of all pairs of shards.
4. Runs of repeated windows go back to all places of their regions and are cut from the texts.

Rules for odd rows: a null text is empty; windows lie within one text; shorter texts lose nothing; rows that repeat an id, or are
wholly equal, are separate documents, so equal rows remove each other's windows; ids may be null; what is kept may cut a UTF-8
character, so it is binary; an empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import row_key, table, written

WINDOW = 400
#: Bytes of an anchor; a power of two.
ANCHOR = 128
#: Bytes of regions in one suffix array, and of one anchor's different regions in one shard.
SHARD_BYTES = 1 << 20
PART_BYTES = 1 << 18

_BASE = 0x9E3779B97F4A7C15


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def regions(raw: bytes, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, number of windows, hash of the anchor) of each run of windows whose first anchor stands at one place."""
    if len(raw) < window:
        empty = np.empty(0, np.int64)
        return empty, empty, empty
    h, width, power = np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1), 1, _BASE
    while width < anchor:  # the hash of twice as many bytes, from two neighbours
        h = h[:-width] * np.uint64(power) + h[width:]
        power, width = power * power % (1 << 64), 2 * width
    h = _mixed(h)
    least, width, need = h, 1, window - anchor + 1
    while 2 * width <= need:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    if width < need:
        least = np.minimum(least[: width - need], least[need - width :])
    # A window whose anchor stands at its begin is the last of that anchor: the next one has another, or a later one of the same bytes.
    at = np.flatnonzero(np.concatenate(([True], (least[1:] != least[:-1]) | (h[: len(least) - 1] == least[:-1]))))
    return at, np.diff(np.append(at, len(least))), least[at].view(np.int64)


def _anchors(batches: Iterator[pa.RecordBatch], window: int, anchor: int) -> Iterator[pa.RecordBatch]:
    """(id, row_key, text) -> id, row_key, h, at, n, digest of every region."""
    names = ["id", "row_key", "h", "at", "n", "digest"]
    for b in batches:
        rows: list = []
        held = 0
        for i, t in enumerate(b.column(2)):
            raw = (t.as_py() or "").encode()
            at, n, h = regions(raw, window, anchor)
            if len(at):
                digests = [hashlib.blake2b(raw[s : s + k + window - 1], digest_size=16).digest() for s, k in zip(at.tolist(), n.tolist(), strict=True)]
                rows.append((np.full(len(at), i), h, at, n, digests))
                held += len(at)
            if held >= 20000 or i == b.num_rows - 1 and rows:
                of, h, at, n = (np.concatenate([r[k] for r in rows]) for k in range(4))
                digest = pa.array([d for r in rows for d in r[4]], pa.binary())
                of = pa.array(of)
                yield pa.RecordBatch.from_arrays([b.column(0).take(of), b.column(1).take(of), pa.array(h), pa.array(at), pa.array(n), digest], names)
                rows, held = [], 0


def _cut_regions(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """(text, list of (h, part, parts, at, n, once, digest)) -> the same fields with the regions' bytes."""
    schema = pa.schema([("h", pa.int64()), ("part", pa.int64()), ("parts", pa.int64()), ("once", pa.bool_()), ("digest", pa.binary()), ("raw", pa.binary())])
    for b in batches:
        rows: list = []
        size = 0
        for t, wanted in zip(b.column(0), b.column(1), strict=True):
            raw = t.as_py().encode()
            for w in wanted.as_py():
                rows.append((w["h"], w["part"], w["parts"], w["once"], w["digest"], raw[w["at"] : w["at"] + w["n"] + window - 1]))
                size += len(rows[-1][-1])
            if size >= 1 << 22:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of text in the order of their suffixes' first ``depth`` bytes, ties by position.

    Larsson-Sadakane refinement: a suffix's rank is where its group begins. Tied groups are sorted by the rank of what follows the
    bytes compared so far; groups of one are never touched again. The last step overlaps, so exactly ``depth`` bytes count.
    """
    n = len(text)
    bits = max(1, n.bit_length())
    used = np.flatnonzero(np.bincount(text, minlength=256))
    code = np.zeros(256, np.int64)
    code[used] = np.arange(1, len(used) + 1)
    width = int(len(used)).bit_length()
    h = max(1, min(depth, (63 - bits) // width))
    coded = np.concatenate((code[text], np.zeros(h, np.int64)))
    key = np.zeros(n, np.int64)
    for k in range(h):
        key = (key << width) | coded[k : k + n]
    packed = np.sort((key << bits) | np.arange(n))
    order, head = packed & ((1 << bits) - 1), packed >> bits
    rank = np.zeros(n + depth, np.int64)  # what lies behind the end ranks first, with the least suffix
    first = np.flatnonzero(np.concatenate(([True], head[1:] != head[:-1])))
    size = np.diff(np.append(first, n))
    rank[order] = np.repeat(first, size)
    open_ = np.flatnonzero(np.repeat(size > 1, size))
    while h < depth and len(open_):
        step = min(h, depth - h)
        i = order[open_]
        group, then = rank[i], rank[i + step] + (i + step < n)
        if 3 * bits <= 63:  # one sort of (group, rank behind, position) in a single number
            packed = np.sort((group << (2 * bits)) | (then << bits) | i)
            order[open_], packed = packed & ((1 << bits) - 1), packed >> bits
            fresh = np.concatenate(([True], packed[1:] != packed[:-1]))
        else:
            by = np.lexsort((i, then, group))
            order[open_] = i[by]
            fresh = np.concatenate(([True], (group[by][1:] != group[by][:-1]) | (then[by][1:] != then[by][:-1])))
        first = np.flatnonzero(fresh)
        size = np.diff(np.append(first, len(open_)))
        rank[order[open_]] = np.repeat(open_[first], size)
        open_ = open_[np.repeat(size > 1, size)]
        h += step
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """For each entry of order but the first, how many bytes its suffix shares with the entry before, each cut at its limit.

    Kasai's lemma: if the predecessor of suffix i is the successor of the predecessor of suffix i-1, what i shares is one byte
    less than what i-1 shares. Only the other suffixes are compared, eight bytes at a time.
    """
    if len(order) < 2:
        return np.empty(0, np.int64)
    before = np.full(len(text), -2, np.int64)
    before[order[1:]] = order[:-1]
    at = np.sort(order)
    at = at[before[at] >= 0]
    linked = np.zeros(len(at), bool)
    linked[1:] = (at[1:] == at[:-1] + 1) & (before[at[1:]] == before[at[:-1]] + 1) & (limit[at[1:]] == limit[at[:-1]]) & (limit[before[at[1:]]] == limit[before[at[:-1]]])
    own = at[~linked]
    other = before[own]
    room = np.minimum(limit[own] - own, limit[other] - other)
    eight = np.lib.stride_tricks.sliding_window_view(np.concatenate((text, np.zeros(8, np.uint8))), 8)
    shared = np.zeros(len(own), np.int64)
    live = np.flatnonzero(room > 0)
    while len(live):
        a, b = own[live] + shared[live], other[live] + shared[live]
        different = eight[a] != eight[b]
        same = np.where(different.any(axis=1), different.argmax(axis=1), 8)
        shared[live] += same
        live = live[(same == 8) & (shared[live] < room[live])]
    shared = np.minimum(shared, room)
    # A linked suffix has what the last compared one before it has, less one byte for each step.
    base = np.maximum.accumulate(np.where(linked, -1, np.arange(len(at))))
    full = np.zeros(len(at), np.int64)
    full[~linked] = shared
    common = np.zeros(len(text), np.int64)
    common[at] = full[base] - (at - at[base])
    return common[order[1:]]


class Shard:
    """Regions side by side and, for each window's start, whether it repeats; and the groups of equal windows."""

    def __init__(self, raws: list[bytes], window: int):
        self.data = b"".join(raws)
        text = np.frombuffer(self.data, np.uint8)
        lengths = np.fromiter(map(len, raws), np.int64, len(raws))
        ends = np.cumsum(lengths)
        self.starts = ends - lengths
        limit = np.repeat(ends, lengths)
        valid = np.arange(len(text)) + window <= limit
        order = suffix_array(text, window)
        #: The windows in order, without suffixes that are shorter.
        self.windows = order[valid[order]]
        same = common_prefixes(text, self.windows, limit) >= window
        self.repeated = np.zeros(len(text), bool)
        self.repeated[self.windows[1:][same]] = True
        self.repeated[self.windows[:-1][same]] = True
        self.first = np.concatenate(([True], ~same)) if len(self.windows) else np.empty(0, bool)
        self.window, self.counts = window, lengths - window + 1

    def runs(self, region: int) -> tuple[list[int], list[int]]:
        """Begins and ends (exclusive) of a region's runs of repeated windows."""
        s = self.starts[region]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], self.repeated[s : s + self.counts[region]], [False])).view(np.int8)))
        return edge[0::2].tolist(), edge[1::2].tolist()

    def digest(self, at: int) -> bytes:
        return hashlib.blake2b(self.data[at : at + self.window], digest_size=16).digest()


#: kind 0: a region (digest) with its runs. 1: an anchor's slice of one part: its sorted digests (key); for each, where the window
#: begins in its region (begin) and the region's number (end) among the digests in ``digest``, or -1 if it repeats in any case.
_FOUND = pa.schema([("kind", pa.int32()), ("h", pa.int64()), ("slice", pa.int64()), ("digest", pa.binary()), ("begin", pa.list_(pa.int64())), ("end", pa.list_(pa.int64())), ("key", pa.binary())])
_FOUND_DDL = "kind int, h long, slice long, digest binary, begin array<long>, end array<long>, key binary"


def _slice_of(digest: bytes, parts: int) -> int:
    return int.from_bytes(digest[:4], "big") * parts >> 32


def _shard_rows(rows: list[tuple], window: int) -> Iterator[tuple]:
    """rows: (h, part, parts, once, digest, raw) of whole (anchor, part) groups."""
    shard = Shard([r[5] for r in rows], window)
    for k, (h, _, _, once, digest, _) in enumerate(rows):
        if once:
            begin, end = shard.runs(k)
            if begin:
                yield 0, h, None, digest, begin, end, None
    hot = np.array([r[2] > 1 for r in rows])
    if hot.any():
        region = np.repeat(np.arange(len(rows)), [len(r[5]) for r in rows])
        slices: dict[tuple[int, int], list[tuple[bytes, int, int]]] = {}
        # A repeated group's first window stands for all of it; the others are known to repeat already.
        for at in shard.windows[shard.first & hot[region[shard.windows]]].tolist():
            key, k = shard.digest(at), int(region[at])
            open_ = rows[k][3] and not shard.repeated[at]
            slices.setdefault((rows[k][0], _slice_of(key, rows[k][2])), []).append((key, at - int(shard.starts[k]), k if open_ else -1))
        for (h, at), keys in slices.items():
            keys.sort()
            own = sorted({k for _, _, k in keys if k >= 0})
            number = {k: i for i, k in enumerate(own)} | {-1: -1}
            yield 1, h, at, b"".join(rows[k][4] for k in own), [b for _, b, _ in keys], [number[k] for _, _, k in keys], b"".join(x for x, _, _ in keys)


def _shards(batches: Iterator[pa.RecordBatch], window: int, shard_bytes: int) -> Iterator[pa.RecordBatch]:
    """(h, part, parts, once, digest, raw), sorted by anchor and part -> what the shards found."""
    def tables() -> Iterator[list[tuple]]:
        held: list[tuple] = []
        size, last = 0, None
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                if row[:2] != last and size >= shard_bytes:
                    yield held
                    held, size = [], 0
                last = row[:2]
                held.append(row)
                size += len(row[5])
        if held:
            yield held

    out: list[tuple] = []
    for rows in tables():
        for found in _shard_rows(rows, window):
            out.append(found)
            if len(out) >= 10000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _FOUND, strict=True)], schema=_FOUND)
                out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _FOUND, strict=True)], schema=_FOUND)


def merged(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(both sorted arrays in one, what both hold): binary search of one array's values in the other."""
    if not len(a) or not len(b):
        return np.concatenate((a, b)), np.empty(0, "S16")
    at = np.searchsorted(a, b)
    both = (at < len(a)) & (a[np.minimum(at, len(a) - 1)] == b)
    return np.insert(a, at[~both], b[~both]), b[both]


def _shared(arrays: list[np.ndarray]) -> np.ndarray:
    """What stands in more than one of the sorted arrays, sorted. They are merged two by two: a value is looked up once a level."""
    twice = []
    while len(arrays) > 1:
        pairs = [merged(arrays[i], arrays[i + 1]) for i in range(0, len(arrays) - 1, 2)]
        twice += [p[1] for p in pairs]
        arrays = [p[0] for p in pairs] + arrays[len(arrays) // 2 * 2 :]
    return np.unique(np.concatenate(twice)) if twice else np.empty(0, "S16")


def _merge_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, slice, key, begin, end, digest) of kind 1, sorted by anchor and slice -> h, digest and the windows of each region that
    repeat because another part has them."""
    schema = pa.schema([("h", pa.int64()), ("digest", pa.binary()), ("begin", pa.list_(pa.int64())), ("end", pa.list_(pa.int64()))])

    def rows(h: int, parts: list[tuple]) -> Iterator[tuple]:
        shared = _shared([p[0] for p in parts])
        for keys, begin, number, digests in parts if len(shared) else []:
            hit = (shared[np.minimum(np.searchsorted(shared, keys), len(shared) - 1)] == keys) & (number >= 0)
            found: dict[int, list[int]] = {}
            for b, k in zip(begin[hit].tolist(), number[hit].tolist(), strict=True):
                found.setdefault(k, []).append(b)
            for k, at in found.items():
                yield h, digests[16 * k : 16 * k + 16], at, [x + 1 for x in at]

    def batch(h: int, parts: list[tuple]) -> pa.RecordBatch:
        out = list(rows(h, parts))
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)

    parts: list[tuple] = []
    last = (0, -1)
    for b in batches:
        for h, at, keys, begin, number, digests in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
            if (h, at) != last:
                yield batch(last[0], parts)
                parts, last = [], (h, at)
            parts.append((np.frombuffer(keys, "S16"), np.array(begin), np.array(number), digests))
    yield batch(last[0], parts)


def repeated_runs(docs: DataFrame, id_column: str = "doc_id", window: int = WINDOW, anchor: int = ANCHOR, shard_bytes: int = SHARD_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """id, row_key, runs (from, to: bytes, end exclusive; sorted) of the rows that lose bytes."""
    base = docs.select(F.col(id_column).cast("long").alias("id"), row_key(id_column).alias("row_key"), F.col("text").alias("text"))
    found = base.mapInArrow(partial(_anchors, window=window, anchor=anchor), "id long, row_key long, h long, at long, n long, digest binary")
    every = written(found, "anchors")
    # Written, so that both sides of the join are shuffled for it and a hot anchor's rows can be split.
    again = written(every.groupBy("h").agg(F.count("*").alias("times")).where("times > 1").select("h"), "anchors-again")
    places = written(every.join(again, "h", "left_semi"), "repeated-anchors")
    different = written(places.groupBy("h", "digest").agg(F.count("*").alias("times"), F.min("n").alias("n"), F.min(F.struct("id", "row_key", "at")).alias("place")), "regions")

    # Anchors with several regions, one of which stands alone: only those need their bytes.
    anchors = different.groupBy("h").agg(F.count("*").alias("regions"), F.min("times").alias("least"), F.sum(F.col("n") + (window - 1)).alias("bytes"))
    anchors = anchors.where("regions > 1 AND least = 1").select("h", F.ceil(F.col("bytes") / F.lit(part_bytes)).cast("long").alias("parts"))
    wanted = different.join(anchors, "h").select("place", F.struct("h", F.pmod(F.xxhash64("digest"), F.col("parts")).alias("part"), "parts", F.col("place.at").alias("at"), "n", (F.col("times") == 1).alias("once"), "digest").alias("region"))
    wanted = wanted.groupBy(F.col("place.id").alias("of_id"), F.col("place.row_key").alias("of_key")).agg(F.collect_list("region").alias("wanted"))
    # Equal rows have one key; either may give the bytes.
    met = base.join(wanted, base["id"].eqNullSafe(wanted["of_id"]) & (base["row_key"] == wanted["of_key"])).select("text", "wanted")
    cut = met.mapInArrow(partial(_cut_regions, window=window), "h long, part long, parts long, once boolean, digest binary, raw binary")
    dealt = cut.repartition("h", "part").sortWithinPartitions("h", "part", "digest")
    shards = written(dealt.mapInArrow(partial(_shards, window=window, shard_bytes=shard_bytes), _FOUND_DDL), "suffix-shards")

    slices = shards.where("kind = 1").select("h", "slice", "key", "begin", "end", "digest").repartition("h", "slice").sortWithinPartitions("h", "slice")
    alone = slices.mapInArrow(_merge_slices, "h long, digest binary, begin array<long>, end array<long>")
    whole = different.where("times > 1").select("h", "digest", F.array(F.lit(0).cast("long")).alias("begin"), F.array("n").alias("end"))
    decided = shards.where("kind = 0").select("h", "digest", "begin", "end").unionByName(alone).unionByName(whole)
    runs = places.join(decided, ["h", "digest"]).select("id", "row_key", "at", F.explode(F.arrays_zip("begin", "end")).alias("r"))
    spans = runs.select("id", "row_key", F.struct((F.col("at") + F.col("r.begin")).alias("begin"), (F.col("at") + F.col("r.end") + (window - 1)).alias("end")).alias("span"))
    return spans.groupBy("id", "row_key").agg(F.array_sort(F.collect_set("span")).alias("runs"))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, runs) -> id, n_bytes, n_removed, n_spans, kept bytes."""
    schema = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])
    for b in batches:
        out: list[tuple] = []
        for i, t, runs in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
            raw = (t.as_py() or "").encode()
            left, at, spans = [], 0, 0
            for r in runs.as_py() or []:
                if r["begin"] > at or not spans:
                    spans += 1
                    left.append(raw[at : r["begin"]])
                at = max(at, r["end"])
            left.append(raw[at:])
            kept = b"".join(left)
            out.append((i, len(raw), len(raw) - len(kept), spans, kept))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def dedup_bytes(docs: DataFrame, id_column: str = "doc_id", **sizes: int) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept (bytes) of every row of docs. sizes: as for repeated_runs."""
    runs = repeated_runs(docs, id_column, **sizes)
    base = docs.select(F.col(id_column).cast("long").alias("id"), row_key(id_column).alias("r_key"), F.col("text").alias("text"))
    met = base.join(runs, (base["r_key"] == runs["row_key"]) & base["id"].eqNullSafe(runs["id"]), "left")
    return met.select(base["id"], "text", "runs").mapInArrow(_kept, "id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def queries() -> dict:
    return {"op12_suffix_dedup": op12_suffix_dedup}


#: Windows are compared by MD5: DuckDB would otherwise hold 400 bytes for each byte of the texts.
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT r, i, md5(b[i:i + {WINDOW - 1}]) AS h FROM (SELECT r, b, unnest(range(1, octet_length(b) - {WINDOW - 2})) AS i FROM d)),
hit AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS c FROM w) WHERE c > 1),
edge AS (SELECT r, i, CASE WHEN i > lag(i) OVER o + {WINDOW} OR lag(i) OVER o IS NULL THEN 1 ELSE 0 END AS fresh FROM hit WINDOW o AS (PARTITION BY r ORDER BY i)),
span AS (SELECT r, min(i) AS lo, max(i) + {WINDOW} AS hi FROM (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM edge) GROUP BY r, g),
gap AS (SELECT r, hi AS lo, lead(lo) OVER (PARTITION BY r ORDER BY lo, hi) AS hi FROM (SELECT r, lo, hi FROM span UNION ALL SELECT r, 1, 1 FROM d)),
k AS (SELECT d.r, d.doc_id, octet_length(d.b) AS n_bytes, string_agg(CASE WHEN gap.lo < coalesce(gap.hi, octet_length(d.b) + 1) THEN hex(d.b[gap.lo:coalesce(gap.hi - 1, octet_length(d.b))]) ELSE '' END, '' ORDER BY gap.lo) AS kept FROM d JOIN gap ON d.r = gap.r GROUP BY ALL)
SELECT doc_id, n_bytes::BIGINT AS n_bytes, (n_bytes - strlen(kept) // 2)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM k LEFT JOIN (SELECT r, count(*) AS n FROM span GROUP BY r) s ON s.r = k.r
"""


def oracle_sql() -> dict:
    return {"op12_suffix_dedup": ORACLE}
