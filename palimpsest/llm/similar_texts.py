"""Near duplicates by SimHash: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

At that similarity two 64-bit fingerprints differ by about ten bits, too many for the keys of one fingerprint. So a text's
fingerprint is wide here: PAIRS pairs of 23-bit segments. Each segment decodes to the Golay codewords near it, and texts that
share a pair of codewords of some pair of segments become candidates. A pair of sets at exactly 0.8 meets with probability
0.989, at 0.85 with 0.998 (the chance that two segments that differ in d bits share a codeword is 1, 1, 1, 0.59, 0.59, 0.19 for
d of 0 to 5). A separate 64-bit lane rules out candidates that differ in more than MOST_LANE of its bits, and the sets themselves
decide, so every link is true.

Texts with equal sets are one node. In a bucket, a node names at first up to FIRST candidates of those before it in the order of
hashes, and buckets that hold more are kept. Once these are linked, all further candidates of such buckets are compared whose
components still differ: a group of very many near copies costs about its rows, not its pairs, and no candidate is left out. Sets are compared in blocks: a block's first sets are held, the others stream past them.

Rules for odd rows: null and empty texts and texts of white space have the empty set and are one group; a text of fewer than
five words is one shingle; ids that are null are the largest; repeated rows are one node, and of equal rows one stays; an empty
table gives an empty result; further columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_key, written
from .simhash import SEED, components, golay, named, shingle_hashes, some_roots

#: Words of a shingle, and the least similarity of a link, as a fraction.
SHINGLE = 5
SIMILAR, OF = 4, 5
#: Pairs of 23-bit segments in a fingerprint.
PAIRS = 10
SEGMENT = 23
#: Most differing bits of the lane: of pairs of sets at 0.8 two in a thousand differ by more.
MOST_LANE = 18
#: Candidates that a node names in a bucket before components are known.
FIRST = 4
#: A bucket of at most so many nodes names all its candidates at once.
SMALL = 8
#: First sets that a block of comparisons holds, and the others that go to one block.
HELD, STREAMED = 256, 512
#: Most rows of a table of frequent nodes that is broadcast.
MOST_FREQUENT = 100_000

_WORDS = -(-(2 * PAIRS * SEGMENT) // 64) + 1
#: Odd constants that turn a shingle's hash into independent lanes.
_TURNS = np.array([xxhash.xxh64_intdigest(bytes([k]), SEED) | 1 for k in range(_WORDS)], np.uint64)

#: A byte's bits as eight bytes, the first bit first.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct hashes, ascending."""
    return np.unique(shingle_hashes(text, shingle))


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """_WORDS words of 64 bits, the last of them the lane; a bit is set if more than half of the hashes' lanes have it."""
    ones = np.zeros(64 * _WORDS, np.int64)
    for at in range(0, len(hashes), 255):  # a byte counts the ones of a bit
        x = hashes[at : at + 255, None] * _TURNS
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        ones += _BITS[x.astype(">u8").view(np.uint8)].reshape(len(x), -1).sum(axis=0, dtype=np.uint64).view(np.uint8)
    return np.packbits(2 * ones > len(hashes)).view(">u8").astype(np.uint64)


def with_prints(docs: DataFrame, id_column: str, shingle: int) -> DataFrame:
    """id, row_key, node (64 bits of the set), print (the fingerprint's bytes) and lane of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, prints, lanes = [], [], []
            for t in b.column(2):
                s = shingle_set(t.as_py(), shingle)
                words = wide_fingerprint(s)
                nodes.append(xxhash.xxh64_intdigest(s.tobytes(), SEED))
                prints.append(words[:-1].tobytes())
                lanes.append(words[-1])
            as_long = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), as_long(nodes), pa.array(prints, pa.binary()), as_long(lanes)], ["id", "row_key", "node", "print", "lane"])

    rows = docs.select(F.col(id_column).alias("id"), row_key(id_column).alias("row_key"), "text")
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, row_key long, node long, print binary, lane long")


def segment_pairs(prints: np.ndarray) -> np.ndarray:
    """(n, words) fingerprints as (n, 2 * PAIRS) segments."""
    bits = np.unpackbits(prints.astype(">u8").view(np.uint8).reshape(len(prints), -1), axis=1)[:, : 2 * PAIRS * SEGMENT]
    weights = (1 << np.arange(SEGMENT - 1, -1, -1)).astype(np.int64)
    return (bits.reshape(len(prints), 2 * PAIRS, SEGMENT) @ weights).astype(np.uint32)


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, print, lane) -> a row for each distinct pair of codewords of each pair of segments."""
    for b in batches:
        for at in range(0, b.num_rows, 2000):
            part = b.slice(at, 2000)
            node, lane = (part.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
            prints = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint64).reshape(part.num_rows, -1)
            seg = segment_pairs(prints)
            found = golay().keys(seg.reshape(-1)).astype(np.int32).reshape(part.num_rows, 2 * PAIRS, 6)
            fresh = np.concatenate((np.ones_like(found[:, :, :1], bool), found[:, :, 1:] != found[:, :, :1]), axis=2)
            for n in range(PAIRS):
                x, y = found[:, 2 * n], found[:, 2 * n + 1]
                key = (np.int32(n << 24) | x[:, :, None] << 12 | y[:, None, :]).reshape(part.num_rows, 36)
                ok = (fresh[:, 2 * n, :, None] & fresh[:, 2 * n + 1, None, :]).reshape(part.num_rows, 36)
                of = np.repeat(np.arange(part.num_rows), 36).reshape(part.num_rows, 36)[ok]
                yield pa.RecordBatch.from_arrays([pa.array(key[ok]), pa.array(node[of]), pa.array(lane[of])], ["key", "node", "lane"])


def _buckets(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[list[np.ndarray]]:
    """The columns of whole buckets, some at a time; rows come sorted by key."""
    held: list[list[np.ndarray]] = []
    for b in batches:
        if not b.num_rows:
            continue
        held.append([b.column(i).to_numpy(zero_copy_only=False) for i in range(columns)])
        if held[-1][0][-1] == held[0][0][0]:
            continue
        every = [np.concatenate(c) for c in zip(*held, strict=True)]
        cut = int(np.searchsorted(every[0], every[0][-1], "left"))
        yield [c[:cut] for c in every]
        held = [[c[cut:] for c in every]]
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _near(lanes: np.ndarray, lane: np.int64) -> np.ndarray:
    return np.flatnonzero(np.bitwise_count((lanes ^ lane).view(np.uint64)) <= MOST_LANE)


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Distinct pairs a < b, with room for the rows of kept buckets."""
    both = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.nulls(len(both), pa.int32()), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.nulls(len(both), pa.int64())], ["key", "a", "b", "lane"])


CANDIDATES = "key int, a long, b long, lane long"


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, node, lane), sorted -> pairs (a, b, without key), and the rows of buckets with further candidates (a is the node)."""
    for key, node, lane in _buckets(batches, 3):
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        sizes = np.diff(np.append(starts, len(key)))
        small = np.repeat(sizes <= SMALL, sizes)
        x, y = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for k in range(1, SMALL):
            i = np.flatnonzero((key[k:] == key[:-k]) & small[k:])
            i = i[np.bitwise_count((lane[i] ^ lane[i + k]).view(np.uint64)) <= MOST_LANE]
            x.append(i)
            y.append(i + k)
        for s, size in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
            own, more = lane[s : s + size], False
            for j in range(1, size):
                found, at, step = [], 0, 64
                while at < j and len(found) <= FIRST:  # most buckets end here: their first nodes are enough, or there are few
                    found += (_near(own[at : min(j, at + step)], own[j]) + at).tolist()
                    at, step = at + step, 8 * step
                more |= len(found) > FIRST
                x.append(np.array(found[:FIRST], np.int64) + s)
                y.append(np.full(len(found[:FIRST]), s + j))
            if more:
                e = s + size
                yield pa.RecordBatch.from_arrays([pa.array(key[s:e]), pa.array(node[s:e]), pa.nulls(size, pa.int64()), pa.array(own)], ["key", "a", "b", "lane"])
        i, j = np.concatenate(x), np.concatenate(y)
        yield _pairs(node[i], node[j])


def _between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, node, lane, root), sorted -> the candidates of a kept bucket that no known component holds both of."""
    for key, node, lane, root in _buckets(batches, 4):
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        x, y = [], []
        for s, e in zip(starts.tolist(), np.append(starts[1:], len(key)).tolist(), strict=True):
            roots, counts = np.unique(root[s:e], return_counts=True)
            own, ids, who = lane[s:e], node[s:e], root[s:e]
            main = roots[np.argmax(counts)]
            for j in np.flatnonzero(who != main).tolist() if len(roots) > 1 else ():
                near = _near(own, own[j])
                near = near[(who[near] != who[j]) & ((who[near] == main) | (near < j))]
                x.append(ids[near])
                y.append(np.full(len(near), ids[j]))
                if sum(map(len, x[-1000:])) > 100_000:
                    yield _pairs(np.concatenate(x), np.concatenate(y))
                    x, y = [], []
        if x:
            yield _pairs(np.concatenate(x), np.concatenate(y))


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of blocks: node, hashes, partners (null for sets that are held; they come first) -> links (a, b)."""
    block, held, out = None, {}, []
    for b in batches:
        columns = (b.column(i) for i in range(5))
        for n, part, node, raw, partners in zip(*(c if i == 3 else c.to_pylist() for i, c in enumerate(columns)), strict=True):
            if (n, part) != block:
                block, held = (n, part), {}
            own = np.frombuffer(raw.as_buffer(), np.uint64)
            if partners is None:
                held[node] = own.copy()
                continue
            for a in partners:
                other = held[a]
                if OF * min(len(own), len(other)) < SIMILAR * max(len(own), len(other)):
                    continue
                at = np.minimum(np.searchsorted(other, own), len(other) - 1)
                shared = int(np.count_nonzero(other[at] == own))
                if OF * shared >= SIMILAR * (len(own) + len(other) - shared):
                    out.append((a, node))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])
        out = []


def similar_links(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, id_column: str, shingle: int) -> DataFrame:
    """The pairs of nodes (a < b) whose sets are similar; sets are made again from the texts of the nodes that are in a pair.

    A pair's first set goes to a block with about HELD others, and each second set once to every block that it has a pair in. A
    first set with very many pairs is held by several blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_set(t.as_py(), shingle).tobytes() for t in b.column(1)], pa.binary())], ["node", "hashes"])

    pairs = written(pairs.distinct(), "pairs")
    firsts = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("c"))
    rows, distinct = firsts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    # At most MOST_FREQUENT nodes can have this many pairs, so the table of them may be broadcast.
    frequent = firsts.where(F.col("c") > max(STREAMED, rows // MOST_FREQUENT)).select(F.col("a").alias("f"), F.expr(f"c div {STREAMED} + 1").alias("parts"))
    placed = pairs.join(F.broadcast(frequent), F.col("a") == F.col("f"), "left").select(
        F.pmod(F.xxhash64("a"), F.lit(distinct // HELD + 1)).alias("block"), F.coalesce(F.pmod(F.xxhash64("b"), F.col("parts")), F.lit(0)).alias("part"), "a", "b")
    seconds = placed.groupBy("block", "part", F.col("b").alias("node")).agg(F.collect_list("a").alias("partners"))
    held = placed.select("block", "part", F.col("a").alias("node")).distinct().withColumn("partners", F.lit(None).cast("array<long>"))
    met = written(held.unionByName(seconds), "blocks")
    keys = nodes.join(met.select("node").distinct(), "node", "left_semi").select("node", "k")
    texts = docs.select(row_key(id_column).alias("k"), "text").join(keys, "k").dropDuplicates(["node"]).select("node", "text")
    sets = texts.mapInArrow(run, "node long, hashes binary")
    ready = met.join(sets, "node").select("block", "part", "node", "hashes", "partners")
    dealt = ready.repartition("block", "part").sortWithinPartitions("block", "part", F.col("partners").isNotNull())
    return written(dealt.mapInArrow(_similar, "a long, b long"), "similar")


def similar_groups(docs: DataFrame, id_column: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """id, row_key, node and component_id (the smallest id reachable over links) of each row."""
    rows = written(with_prints(docs, id_column, shingle), "prints")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Each node unfolds to some hundred rows, so nodes are spread over all tasks.
    merged = rows.groupBy("node").agg(F.min("id").alias("least"), F.min("row_key").alias("k"), F.min("print").alias("print"), F.min("lane").alias("lane"))
    nodes = written(merged.repartition(parts, "node"), "nodes")
    keyed = nodes.select("node", "print", "lane").mapInArrow(_key_rows, "key int, node long, lane long")
    dealt = keyed.repartition("key").sortWithinPartitions("key", "node")
    found = written(dealt.mapInArrow(_candidates, CANDIDATES), "candidates")
    links = similar_links(found.where("key IS NULL").select("a", "b"), nodes, docs, id_column, shingle)
    kept = found.where("key IS NOT NULL").select("key", F.col("a").alias("node"), "lane")
    if not kept.isEmpty():
        roots = some_roots(links).withColumnRenamed("node", "r_node")
        met = kept.join(roots, kept["node"] == roots["r_node"], "left").select("key", "node", "lane", F.coalesce("root", "node").alias("root"))
        pairs = met.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_between, CANDIDATES)
        links = links.unionAll(similar_links(pairs.select("a", "b"), nodes, docs, id_column, shingle))
    reach = components(links)
    return named(rows.select("id", "row_key", "node"), nodes.select("node", "least"), reach)


def representatives(docs: DataFrame, id_column: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """One document of each group stays: the row with the group's smallest id (of rows that share it, one)."""
    groups = similar_groups(docs, id_column, shingle)
    same = groups.where(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("component_id", "row_key").agg(F.count(F.lit(1)).alias("copies"))
    kept = written(same.groupBy("component_id").agg(F.min(F.struct("row_key", "copies")).alias("k")).select("component_id", F.col("k.row_key").alias("kept_key"), "k.copies"), "kept")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_column).alias("r_id"), row_key(id_column).alias("r_key"))
    met = rows.join(kept, (rows["r_key"] == kept["kept_key"]) & rows["r_id"].eqNullSafe(kept["component_id"]), "left_semi")
    # Wholly equal rows are rare; the texts are dealt again only if a kept row has such copies.
    one = met if kept.where("copies > 1").isEmpty() else met.dropDuplicates(["r_id", "r_key"])
    return one.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
