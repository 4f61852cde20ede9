"""SimHash near-dedup: fingerprints of word shingles, linked by Golay-code fuzzy hashing.

A fingerprint's 64 bits are three segments (23, 23 and 18 bits, the last padded with zeros to 23). The perfect Golay code of
length 23 puts every word within 3 errors of one codeword. A segment's keys are the codewords that its word or one of its 23
neighbours decodes to: one, or six where the word lies 3 errors from its own. Two words at distance 2 or less share a key: the
word between them decodes to it. By the pigeonhole principle two fingerprints within 4 bits differ by at most 2 bits in each
of some two segments (or by more in one segment only, and then agree in the others), so they share a pair of keys for a pair of
segments. Fingerprints are joined on (pair of segments, pair of keys) and verified bit by bit.

Equal fingerprints become one node first, so copies cost nothing. A bucket's fingerprints are linked by a search that takes
each fingerprint out of the rest as soon as it is reached, and yields a spanning forest of the bucket's links instead of its
pairs; the union over the buckets has the same components as all links. Components are found by rounds of joins that are
written to the shared folder.

Rules for odd rows: null and empty texts, and texts of white space, have fingerprint zero, linked like any other; ids that are
null form components of their own value only with rows of the same fingerprint neighbourhood (null is larger than any id, so a
component takes its smallest id that is not null, if it has one); repeated rows are separate rows of one node; an empty table
gives an empty result; further columns pass through or are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import row_key, table, written

#: Words of a shingle, seed of its hash, and most differing bits of a link (the query's contract).
SHINGLE = 4
SEED = 42
MOST_BITS = 4
#: Parts that a node's neighbours are taken in when components are found, and the most components that count as large.
SALTS = 256
MOST_LARGE = 100_000
#: Links that a task contracts at once.
EDGES = 20_000
#: A bucket of at most so many fingerprints is compared row by row.
SMALL = 8

GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 of the Golay code, by ascending power


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The hash of each shingle; a text of fewer words is one shingle, and a text without words has none."""
    raw = (text or "").encode().lower()
    words = raw.split()
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) + np.arange(len(words))
    first = np.concatenate(([0], ends[:-1] + 1))
    if len(words) <= shingle:
        spans = [(0, len(line))]
    else:
        spans = zip(first[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], SEED) for a, b in spans], np.uint64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """A bit is set if more than half of the shingles' hashes have it."""
    hashes = shingle_hashes(text, shingle)
    if not len(hashes):
        return 0
    ones = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def with_fingerprints(docs: DataFrame, id_column: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """id, row_key, fp (the 64 bits as a signed long) of each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(2)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64))], ["id", "row_key", "fp"])

    rows = docs.select(F.col(id_column).alias("id"), row_key(id_column).alias("row_key"), "text")
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, row_key long, fp long")


class Golay:
    """Codeword indices for arrays of 23-bit words."""

    def __init__(self) -> None:
        g = int(f"{GENERATOR:012b}"[::-1], 2)
        self.low = self._syndromes(np.arange(1 << 12, dtype=np.uint32), g)
        self.high = self._syndromes(np.arange(1 << 11, dtype=np.uint32) << np.uint32(12), g)
        one = np.uint32(1) << np.arange(23, dtype=np.uint32)
        near = {0: 0}
        weight: dict[int, int] = {0: 0}
        for n in (1, 2, 3):
            for e in self._patterns(one, n):
                s = int(self._of(np.array([e], np.uint32))[0])
                near.setdefault(s, e)
                weight.setdefault(s, n)
        #: Error patterns of each syndrome: the least, then those that a neighbour of the word leads to.
        self.errors = np.zeros((1 << 11, 6), np.uint32)
        for s in range(1 << 11):
            found = [near[s]]
            if weight[s] == 3:
                unit = self._of(one)
                found += sorted({near[int(s ^ unit[i])] ^ int(one[i]) for i in range(23)} - {near[s]})
            assert len(found) in (1, 6)
            self.errors[s] = found + [found[0]] * (6 - len(found))

    @staticmethod
    def _patterns(one: np.ndarray, n: int) -> Iterator[int]:
        from itertools import combinations

        return (int(sum(int(one[i]) for i in c)) for c in combinations(range(23), n))

    @staticmethod
    def _syndromes(words: np.ndarray, g: int) -> np.ndarray:
        """Remainders of division by the generator."""
        r = words.copy()
        for i in range(22, 10, -1):
            r = np.where(r >> np.uint32(i) & np.uint32(1), r ^ np.uint32(g << (i - 11)), r)
        return r

    def _of(self, words: np.ndarray) -> np.ndarray:
        return self.low[words & np.uint32(0xFFF)] ^ self.high[words >> np.uint32(12)]

    def keys(self, words: np.ndarray) -> np.ndarray:
        """(n, 6) codeword indices; fewer than six keys are repeated. The code is systematic: the upper 12 bits tell a codeword."""
        return (words[:, None] ^ self.errors[self._of(words)]) >> np.uint32(11)


_golay: list[Golay] = []


def golay() -> Golay:
    if not _golay:
        _golay.append(Golay())
    return _golay[0]


def segments(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a = (fps >> np.uint64(41)).astype(np.uint32)
    b = (fps >> np.uint64(18) & np.uint64(0x7FFFFF)).astype(np.uint32)
    return a, b, (fps & np.uint64(0x3FFFF)).astype(np.uint32)


def bucket_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, index of its fingerprint) for every distinct pair of keys of every pair of segments."""
    keys = [golay().keys(s).astype(np.int64) for s in segments(fps)]
    out, of = [], []
    index = np.arange(len(fps), dtype=np.int64)
    for n, (x, y) in enumerate(((0, 1), (0, 2), (1, 2))):
        pair = ((n << 24) | keys[x][:, :, None] << 12 | keys[y][:, None, :]).reshape(len(fps), 36)
        fresh_x = np.concatenate((np.ones((len(fps), 1), bool), keys[x][:, 1:] != keys[x][:, :1]), axis=1)
        fresh_y = np.concatenate((np.ones((len(fps), 1), bool), keys[y][:, 1:] != keys[y][:, :1]), axis=1)
        fresh = (fresh_x[:, :, None] & fresh_y[:, None, :]).reshape(len(fps), 36)
        out.append(pair[fresh])
        of.append(np.repeat(index, 36).reshape(len(fps), 36)[fresh])
    return np.concatenate(out), np.concatenate(of)


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for at in range(0, len(fps), 5000):
            part = fps[at : at + 5000]
            keys, of = bucket_keys(part.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[of])], ["key", "fp"])


def forest(fps: np.ndarray, most: int = MOST_BITS) -> list[tuple[int, int]]:
    """Links that span the components of distinct fingerprints within ``most`` bits of one another."""
    rest, links = fps, []
    while len(rest) > 1:
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            x = todo.pop()
            near = np.bitwise_count(rest ^ x) <= most
            if near.any():
                links += [(int(x), int(y)) for y in rest[near]]
                todo += list(rest[near])
                rest = rest[~near]
    return links


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key. A key's rows are held until the next key begins."""

    def linked(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        sizes = np.diff(np.append(starts, len(keys)))
        small = np.repeat(sizes <= SMALL, sizes)
        u = fps.view(np.uint64)
        a, b = [], []
        for k in range(1, SMALL):
            same = np.flatnonzero((keys[k:] == keys[:-k]) & small[k:])
            same = same[np.bitwise_count(u[same] ^ u[same + k]) <= MOST_BITS]
            a.append(fps[same])
            b.append(fps[same + k])
        for s, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
            if links := forest(u[s : s + n]):
                pair = np.array(links, np.uint64).view(np.int64)
                a.append(pair[:, 0])
                b.append(pair[:, 1])
        x, y = np.concatenate(a), np.concatenate(b)
        both = np.unique(np.stack((np.minimum(x, y), np.maximum(x, y)), axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    keys, fps = np.empty(0, np.int64), np.empty(0, np.int64)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        k, f = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
        if not len(k):
            continue
        held.append((k, f))
        if k[-1] == held[0][0][0]:  # all of one key so far
            continue
        keys, fps = (np.concatenate([h[i] for h in held]) for i in (0, 1))
        cut = int(np.searchsorted(keys, keys[-1], "left"))
        yield linked(keys[:cut], fps[:cut])
        held = [(keys[cut:], fps[cut:])]
    if held:
        yield linked(*(np.concatenate([h[i] for h in held]) for i in (0, 1)))


def links_of(nodes: DataFrame) -> DataFrame:
    """Distinct links (a < b) that span the components of the nodes' fingerprints (fp: distinct longs)."""
    keyed = nodes.select("fp").mapInArrow(_key_rows, "key long, fp long")
    dealt = keyed.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(_bucket_links, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """node and root (the least node that links reach) of every node with a link, by alternating large and small stars.

    A large star links a node's larger neighbours to the least of all, a small star its smaller neighbours. A node's neighbours
    are taken in SALTS parts: each is linked to the least of its part, and these to the least of all, so a node with very many
    neighbours is no single task. Before a round, links are contracted within tasks of about EDGES. Every round is written to the
    shared folder; rounds end when the links no longer change, which they do: an end only ever gives way to a smaller one.
    """

    def stars(edges: DataFrame, larger: bool) -> DataFrame:
        turned = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
        ends = edges.unionAll(turned) if larger else turned
        salted = ends.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
        least = salted.withColumn("m", F.least(F.col("a"), F.min("b").over(Window.partitionBy("a", "salt"))))
        moved = (least.where("b > a") if larger else least).select(F.col("b").alias("x"), F.col("m").alias("y"))
        # At most SALTS rows of a node meet here.
        parts = least.select("a", "m").distinct().withColumn("all", F.min("m").over(Window.partitionBy("a")))
        out = moved.unionAll(parts.select(F.col("m").alias("x"), F.col("all").alias("y"))).unionAll(parts.select(F.col("a").alias("x"), F.col("all").alias("y")))
        return out.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()

    def state(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())

    edges, was = written(links.select("a", "b").distinct(), "links"), None
    while was != (now := state(edges)):
        tasks = now[0] // EDGES + 1
        edges, was = contracted(edges, tasks), now
        if tasks == 1:  # one task has seen all links
            edges = written(edges, "links")
            break
        edges = written(stars(stars(edges, True), False), "links")
    ends = edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return ends.unionAll(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's links, EDGES at a time, as links of every node to the least node of its component among them."""

    def stars(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
        x, y, label, was = at[: len(a)], at[len(a) :], np.arange(len(nodes)), None
        while was is None or (label != was).any():
            was = label.copy()
            np.minimum.at(label, x, was[y])
            np.minimum.at(label, y, was[x])
            label = label[label]
        moved = np.flatnonzero(label != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[label[moved]]), pa.array(nodes[moved])], ["a", "b"])

    held, n = [], 0
    for batch in batches:
        held.append([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1)])
        n += batch.num_rows
        if n >= EDGES:
            yield stars(*(np.concatenate(c) for c in zip(*held, strict=True)))
            held, n = [], 0
    if held:
        yield stars(*(np.concatenate(c) for c in zip(*held, strict=True)))


def contracted(links: DataFrame, tasks: int) -> DataFrame:
    """Fewer links with the same components: those of a task are replaced by stars. links: a written table."""
    return links.select("a", "b").coalesce(tasks).mapInArrow(_contracted, "a long, b long")


def some_roots(links: DataFrame) -> DataFrame:
    """node and root of nodes with a link: nodes with the same root are in one component; the reverse need not hold."""
    edges = contracted(links, links.count() // EDGES + 1)
    both = edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionAll(edges.select(F.col("a").alias("node"), F.col("a").alias("root")))
    return written(both.groupBy("node").agg(F.min("root").alias("root")), "roots")


def grouped(docs: DataFrame, id_column: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """id, row_key, fp and component_id (the smallest id reachable) of each row of docs."""
    rows = written(with_fingerprints(docs, id_column, shingle), "fingerprints")
    nodes = rows.groupBy("fp").agg(F.min("id").alias("least"))
    reach = components(links_of(nodes))
    return named(rows.withColumnRenamed("fp", "node"), nodes.withColumnRenamed("fp", "node"), reach).withColumnRenamed("node", "fp")


def named(rows: DataFrame, nodes: DataFrame, reach: DataFrame) -> DataFrame:
    """The rows (id, row_key, node) with their component's smallest id. nodes: node, least (its smallest id).

    Roots with very many nodes are brought to them by broadcast (no more than MOST_LARGE can be that large), the others by join.
    """
    joined = nodes.join(reach.withColumnRenamed("node", "r_node"), F.col("node") == F.col("r_node"), "left").select("node", "least", "root")
    linked, alone = joined.where("root IS NOT NULL"), joined.where("root IS NULL")
    roots = written(linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n")), "roots")
    most = max(1000, (roots.agg(F.sum("n")).first()[0] or 0) // MOST_LARGE)
    large = F.broadcast(roots.where(F.col("n") > most).select(F.col("root").alias("l_root"), F.col("component_id").alias("l_id"), F.lit(True).alias("is_large")))
    marked = linked.join(large, F.col("root") == F.col("l_root"), "left")
    few = marked.where("is_large IS NULL").select("node", "root").join(roots.select("root", "component_id"), "root").select("node", "component_id")
    many = marked.where("is_large").select("node", F.col("l_id").alias("component_id"))
    all_named = few.unionAll(many).unionAll(alone.select("node", F.col("least").alias("component_id")))
    found = written(all_named.withColumnRenamed("node", "n_node"), "components")
    return rows.join(found, F.col("node") == F.col("n_node")).select("id", "row_key", "node", "component_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = grouped(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def queries() -> dict:
    return {"op8_simhash": op8_simhash}


def oracle_sql() -> dict:
    return {}


def brute_force(ids: list, texts: list, shingle: int = SHINGLE) -> pd.DataFrame:
    """The query's rows by comparing all fingerprints; for tests on small tables."""
    fps = np.array([fingerprint(t, shingle) for t in texts], np.uint64)
    group = list(range(len(ids)))
    changed = True
    while changed:
        changed = False
        for i in range(len(ids)):
            best = min(group[j] for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= MOST_BITS))
            if best < group[i]:
                group[i], changed = best, True
    least = pd.DataFrame({"g": group, "id": ids}).groupby("g")["id"].min()
    return pd.DataFrame({"doc_id": ids, "fingerprint": [f"{int(f):016x}" for f in fps], "component_id": [least[g] for g in group]})
