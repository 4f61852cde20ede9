"""SentencePiece encoding and decoding; giant documents by a max-plus scan over chunks.

A model file's pieces and scores fix one segmentation of a text. Whether two neighbouring pieces may stand side by side depends
on these two alone: a sequence of pieces is the encoding of its text exactly if every two neighbours encode to themselves. So
the segmentation is the one path through the lattice of pieces whose steps all weigh 0, where a step between pieces that don't
fit weighs minus infinity: a max-plus product. A text of up to CHUNK characters is one chunk with known states at both ends. A
longer one is cut into chunks; a state at a cut is the piece that ends at it or crosses it, as (characters before, characters
behind). Each chunk yields its transfer matrix from entry states to exit states on its own; a tree of products of neighbours
gives the whole text's matrix, and going down the tree again the state at every cut; then every chunk is traced back on its own
between its two states. Up to BLOCK chunks stay in the task of their row. The chunks of longer texts are rows of their own, and
each level of the tree is a shuffle in which BLOCK neighbours meet, so no task holds more than that of one text. Inside a chunk
pieces can't cross the start of a run of spaces, so only what lies before the first and after the last such start takes part in
the matrix; the words between are encoded by the SentencePiece library.

The text is encoded as the model asks: spaces as U+2581 after one more at the front, nothing else normalised; characters that
no piece has become their bytes' pieces. Decoding joins the pieces; it returns the text, with a space for each U+2581 in it.

Rules for odd rows: null and empty texts have no pieces; texts of any length are encoded whole; wholly equal rows stay separate
rows; an empty table gives an empty result; further columns pass through or are ignored, whatever their names.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from itertools import batched, chain, groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import row_key, table, text_of, written

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters of a chunk. A last chunk has up to MARGIN more.
CHUNK = 2048
MARGIN = 64
#: Chunks of one text that a task multiplies.
BLOCK = 32
SPACE = "▁"
#: Characters or ids that a worker handles at once.
PART = 1 << 20
#: Pairs of pieces that a worker remembers before it starts anew.
REMEMBERED = 1 << 20

State = tuple[int, int]
#: Entry states, and exit state -> entries from which a path of weight 0 leads to it, as bits; anything else weighs minus infinity.
Matrix = tuple[list[State], dict[State, int]]


class Pieces:
    """A model's pieces: which may be neighbours, and the library that encodes what has no open ends."""

    def __init__(self, model: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        lib = self.library
        ids = [i for i in range(lib.get_piece_size()) if not (lib.is_control(i) or lib.is_byte(i) or lib.is_unknown(i) or lib.is_unused(i))]
        self.ids = {lib.id_to_piece(i): i for i in ids}
        self.score = {lib.id_to_piece(i): lib.get_score(i) for i in ids}
        self.bytes = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.longest = max(map(len, self.ids))
        if any(SPACE in p.lstrip(SPACE) for p in self.ids) or lib.is_unknown(self.bytes[0]):
            raise ValueError("pieces with a space behind a letter, or a model without byte pieces, can't be encoded by parts")
        self.pairs: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text: the best-scored pair of neighbours is joined first, of equals the leftmost."""
        parts = list(text)
        while True:
            best = max(((self.score[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.score), default=None)
            if best is None:
                return parts
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def fit(self, a: str, b: str) -> bool:
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) > REMEMBERED:
                self.pairs.clear()
            found = self.pairs[a, b] = self.merged(a + b) == [a, b]
        return found

    def starting(self, s: str, at: int) -> Iterator[int]:
        """Ends of the pieces that can start at a place; a character that no piece has stands alone."""
        yield at + 1
        for end in range(at + 2, min(at + self.longest, len(s)) + 1):
            p = s[at:end]
            if p in self.ids:
                ok = self.whole.get(p)
                if ok is None:
                    ok = self.whole[p] = self.merged(p) == [p]
                if ok:
                    yield end

    def encode(self, text: str) -> list[int]:
        """Ids of a text with known ends."""
        return self.library.encode(text, out_type=int)

    def id_list(self, piece: str) -> list[int]:
        found = self.ids.get(piece)
        return [self.bytes[b] for b in piece.encode()] if found is None else [found]


_loaded: dict[str, Pieces] = {}


def pieces(model: str) -> Pieces:
    """The model of this worker: by its path if the worker has it there, else as a file that the session sends along."""
    if model not in _loaded:
        _loaded[model] = Pieces(model if os.path.exists(model) else SparkFiles.get(os.path.basename(model)))
    return _loaded[model]


class Chunk:
    """A stretch of a text with what lies around it: s[start:end] within s."""

    def __init__(self, p: Pieces, left: str, body: str, right: str):
        self.p, self.s = p, left + body + right
        self.start, self.end = len(left), len(left) + len(body)
        self.first, self.last = not left, not right
        cuts = [i for i in (self._cut(self.start, self.end, True), self._cut(self.start, self.end, False)) if i is not None]
        self.inner = (cuts[0], cuts[1]) if cuts else None

    def _cut(self, lo: int, hi: int, ahead: bool) -> int | None:
        """The first or last place where a run of spaces starts."""
        s = self.s
        find = (lambda a, b: s.find(SPACE, a, b)) if ahead else (lambda a, b: s.rfind(SPACE, a, b))
        i = find(lo, hi)
        while i >= 0:
            if i == 0 or s[i - 1] != SPACE:
                return i
            lo, hi = (i + 1, hi) if ahead else (lo, i)
            i = find(lo, hi)
        return None

    def entries(self) -> list[State]:
        """States at the chunk's start, in order."""
        if self.first:
            return [(0, 0)]
        at = self.start
        return sorted((a - at, b - at) for a in range(max(0, at - self.p.longest), at) for b in self.p.starting(self.s, a) if b >= at)

    def _reach(self, ends: dict[int, list[tuple[int, int]]], hi: int) -> dict[int, list[tuple[int, int]]]:
        """Extends {end: [(start, which entries reach it, as bits)]} by every piece that starts before hi. A start of -1 fits all."""
        for at in range(min(ends), hi):
            before = ends.get(at)
            if before:
                for b in self.p.starting(self.s, at):
                    piece, bits = self.s[at:b], 0
                    for a, m in before:
                        if m & ~bits and (a < 0 or self.p.fit(self.s[a:at], piece)):
                            bits |= m
                    if bits:
                        ends.setdefault(b, []).append((at, bits))
        return ends

    def _from_entries(self, states: list[State], hi: int) -> dict[int, list[tuple[int, int]]]:
        ends: dict[int, list[tuple[int, int]]] = {}
        for i, (a, b) in enumerate(states):
            ends.setdefault(self.start + b, []).append((-1 if self.first else self.start + a, 1 << i))
        return self._reach(ends, hi)

    def _exits(self, ends: dict[int, list[tuple[int, int]]]) -> dict[State, int]:
        return {(a - self.end, b - self.end): m for b, nodes in ends.items() if b >= self.end and not (self.last and b > self.end) for a, m in nodes if 0 <= a < self.end}

    def matrix(self) -> Matrix:
        states = self.entries()
        if self.inner is None:
            return states, self._exits(self._from_entries(states, self.end))
        head, tail = self.inner
        bits = 0
        for a, m in (self._from_entries(states, head) if head > self.start or not self.first else {head: [(-1, 1)]}).get(head, []):
            bits |= m
        return states, {state: bits for state in self._exits(self._reach({tail: [(-1, 1)]}, self.end))}

    def _path(self, ends: dict[int, list[tuple[int, int]]], start: int, goal: tuple[int, int]) -> list[int]:
        """Ids of the pieces from a place to the piece goal (start, end), which is the last."""
        out, node = [], goal
        while True:
            a, b = node
            out.append(self.s[a:b])
            if a == start:
                break
            node = next((x, a) for x, _ in ends[a] if x >= start and self.p.fit(self.s[x:a], self.s[a:b]))
        return [i for piece in reversed(out) for i in self.p.id_list(piece)]

    def trace(self, entry: State, leave: State) -> list[int]:
        """Ids of the pieces that start in the chunk, given its states."""
        begin, goal = self.start + entry[1], (self.end + leave[0], self.end + leave[1])
        if self.inner is None:
            ends = self._from_entries([entry], self.end)
            return self._path(ends, begin, goal)
        head, tail = self.inner
        ids: list[int] = []
        if begin < head:
            ends = self._from_entries([entry], head)
            ids += self._path(ends, begin, (next(a for a, _ in ends[head] if a >= begin), head))
        if head < tail:
            ids += self.p.encode(self.s[head + 1 : tail].replace(SPACE, " "))
        return ids + self._path(self._reach({tail: [(-1, 1)]}, self.end), tail, goal)


def product(a: Matrix, b: Matrix) -> Matrix:
    """The matrix of two neighbours: associative."""
    (entries, first), (between, second) = a, b
    cells = {}
    for leave, m in second.items():
        bits = 0
        for i, state in enumerate(between):
            if m >> i & 1:
                bits |= first.get(state, 0)
        if bits:
            cells[leave] = bits
    return entries, cells


def tree(matrices: list[Matrix]) -> list[list[Matrix]]:
    """Levels of products of neighbours, up to the one matrix of them all."""
    levels = [matrices]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([product(*low[i : i + 2]) if i + 1 < len(low) else low[i] for i in range(0, len(low), 2)])
    return levels


def outer(matrix: Matrix) -> tuple[State, State]:
    """States at the ends of a whole text: one path leads through it."""
    ((start,), cells) = matrix
    (end,) = cells
    return start, end


def states_of(levels: list[list[Matrix]], entry: State, leave: State) -> list[tuple[State, State]]:
    """(entry, exit) of every matrix at the foot of a tree, given those of its top."""
    spans = [(entry, leave)]
    for low in levels[-2::-1]:
        found = []
        for j, (e, x) in enumerate(spans):
            if 2 * j + 1 == len(low):
                found.append((e, x))
                continue
            (entries, first), (between, second) = low[2 * j : 2 * j + 2]
            at = entries.index(e)
            (state,) = [s for i, s in enumerate(between) if second[x] >> i & 1 and first.get(s, 0) >> at & 1]
            found += [(e, state), (state, x)]
        spans = found
    return spans


def scanned(p: Pieces, text: str, chunk: int) -> list[int]:
    """Ids of a text whose chunks are all at hand."""
    chunks = [Chunk(p, left, body, right) for _, left, body, right in cut_text(escaped(text), p.longest, chunk)]
    levels = tree([c.matrix() for c in chunks])
    return [i for c, (e, x) in zip(chunks, states_of(levels, *outer(levels[-1][0]))) for i in c.trace(e, x)]


def _send(spark: SparkSession, model: str) -> str:
    """Makes a model file of the driver's available to workers that don't have it at its path."""
    if os.path.exists(model) and os.path.basename(model) not in {os.path.basename(f) for f in spark.sparkContext.listFiles}:
        spark.sparkContext.addFile(model)
    return model


def _parts(batch: pa.RecordBatch, sizes: pa.Array) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about PART by size, so that Python's objects for a few rows exist at a time."""
    at, total = 0, 0
    for i, n in enumerate(sizes.to_pylist()):
        total += n or 0
        if total >= PART:
            yield batch.slice(at, i + 1 - at)
            at, total = i + 1, 0
    if at < batch.num_rows:
        yield batch.slice(at)


def _id_lists(lists: list[list[int]]) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.fromiter(chain.from_iterable(lists), np.int32, int(ends[-1]))))


def _texts_of(p: Pieces, column: pa.Array) -> pa.Array:
    """Texts of lists of ids."""
    ids, ends = column.values.to_numpy(), column.offsets.to_numpy()
    return pa.array([p.library.decode(ids[a:b].tolist()) if ok else None for a, b, ok in zip(ends, ends[1:], column.is_valid().to_pylist())], pa.string())


def cut_text(text: str, longest: int, chunk: int) -> Iterator[tuple[int, str, str, str]]:
    """(number, left, body, right) of the chunks of an escaped text."""
    n = max(1, (len(text) - MARGIN) // chunk)
    for k in range(n):
        a, b = k * chunk, (k + 1) * chunk if k < n - 1 else len(text)
        yield k, text[max(0, a - longest) : a], text[a:b], text[b : b + longest]


def escaped(text: str) -> str:
    return SPACE + text.replace(" ", SPACE)


def encoded(docs: DataFrame, id_column: str = "doc_id", model: str = MODEL, chunk: int = CHUNK, block: int = BLOCK, back: bool = False) -> DataFrame:
    """docs as ``row`` with ``ids`` (array<int>); with ``back`` also the texts that decoding the ids gives, in the workers that encode."""
    model = _send(docs.sparkSession, model)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text_of().alias("t"), F.col(id_column).alias("id"), row_key(id_column).alias("key"))
    giant = F.length("t") > chunk * block

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model)
        for b in batches:
            for part in _parts(b, pc.utf8_length(b.column(0).field("text"))):
                texts = [t or "" for t in part.column(0).field("text").to_pylist()]
                short = iter(p.library.encode([t for t in texts if len(t) <= chunk], out_type=int, num_threads=1))
                ids = _id_lists([next(short) if len(t) <= chunk else scanned(p, t, chunk) for t in texts])
                columns = {"row": part.column(0), "ids": ids} | ({"back": _texts_of(p, ids)} if back else {})
                yield pa.RecordBatch.from_pydict(columns)

    kind = rows.schema["row"].dataType
    fields = [T.StructField("row", kind), T.StructField("ids", T.ArrayType(T.IntegerType())), *([T.StructField("back", T.StringType())] if back else [])]
    short = rows.where(~giant).select("row").mapInArrow(encode, T.StructType(fields))
    long = rows.where(giant)
    ids = _spread(long.select("id", "key", "t"), model, chunk, block)
    met = long.select("row", "id", "key").join(ids, (long["key"] == ids["k_key"]) & long["id"].eqNullSafe(ids["k_id"])).select("row", "ids")
    return short.unionByName(met.withColumn("back", decoded(F.col("ids"), model)) if back else met)


def _to_json(matrix: Matrix) -> str:
    entries, cells = matrix
    return json.dumps([entries, [[*s, str(m)] for s, m in sorted(cells.items())]])


def _from_json(text: str) -> Matrix:
    entries, cells = json.loads(text)
    return [tuple(e) for e in entries], {(a, b): int(m) for a, b, m in cells}


def _spread(texts: DataFrame, model: str, chunk: int, block: int) -> DataFrame:
    """k_id, k_key, ids of giant texts (id, key, t), whose chunks are rows."""
    kind, id_type = texts.schema["id"].dataType.simpleString(), to_arrow_type(texts.schema["id"].dataType)
    place, spot = ["id", "key", "n"], f"id {kind}, key long, n long"
    span = pa.list_(pa.int32())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longest = pieces(model).longest
        for b in batches:
            for i in range(b.num_rows):
                for found in batched(cut_text(escaped(b.column(2)[i].as_py()), longest, chunk), PART // chunk + 1):
                    own = pa.array([i] * len(found))
                    yield pa.RecordBatch.from_arrays([b.column(0).take(own), b.column(1).take(own), *(pa.array(x) for x in zip(*found))], [*place, "l", "body", "r"])

    def matrix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model)
        for b in batches:
            out = [_to_json(Chunk(p, *parts).matrix()) for parts in zip(*(b.column(k).to_pylist() for k in (3, 4, 5)))]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(3)), pa.array(out, pa.string())], [*place, "matrix"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
        """Rows come sorted by text and number; a block's are held until the next begins, repeated rows once."""
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        return ((k, list({r[2]: r for r in group}.values())) for k, group in groupby(rows, key=lambda r: (r[0], r[1], r[2] // block)))

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, rows in blocks(batches):
            top = tree([_from_json(r[3]) for r in rows])[-1][0]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*k, _to_json(top)), (id_type, pa.int64(), pa.int64(), pa.string()))], [*place, "matrix"])

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends = [outer(_from_json(m)) for m in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *(pa.array([list(e[i]) for e in ends], span) for i in (0, 1))], [*place, "entry", "leave"])

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (i, key, _), rows in blocks(batches):
            found = states_of(tree([_from_json(r[3]) for r in rows]), tuple(rows[0][4]), tuple(rows[0][5]))
            columns = [[i] * len(rows), [key] * len(rows), [r[2] for r in rows], [list(e) for e, _ in found], [list(x) for _, x in found]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (id_type, pa.int64(), pa.int64(), span, span))], [*place, "entry", "leave"])

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model)
        for b in batches:
            out = [Chunk(p, left, body, right).trace(tuple(e), tuple(x)) for left, body, right, e, x in zip(*(b.column(k).to_pylist() for k in range(3, 8)))]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(3)), pa.array(out, pa.list_(pa.int32()))], [*place, "part"])

    def met(rows: DataFrame, spans: DataFrame, above: Column) -> DataFrame:
        s = spans.select(F.col("id").alias("s_id"), F.col("key").alias("s_key"), F.col("n").alias("s_n"), "entry", "leave")
        return rows.join(s, (F.col("key") == F.col("s_key")) & (above == F.col("s_n")) & F.col("id").eqNullSafe(F.col("s_id"))).drop("s_id", "s_key", "s_n")

    number = F.floor(F.col("n") / block)
    in_blocks = lambda df: df.repartition("id", "key", number).sortWithinPartitions(*place)
    chunks = written(texts.mapInArrow(cut, f"{spot}, l string, body string, r string").repartition(*place), "chunks")
    levels = [written(chunks.mapInArrow(matrix, f"{spot}, matrix string"), "matrices")]
    while (levels[-1].agg(F.max("n")).first()[0] or 0) > 0:
        levels.append(written(in_blocks(levels[-1]).mapInArrow(up, f"{spot}, matrix string"), "products"))
    states = levels.pop().mapInArrow(top, f"{spot}, entry array<int>, leave array<int>")
    for low in reversed(levels):
        states = in_blocks(met(low, states, number)).mapInArrow(down, f"{spot}, entry array<int>, leave array<int>")
    parts = met(chunks, states, F.col("n")).mapInArrow(trace, f"{spot}, part array<int>")
    whole = parts.groupBy("id", "key").agg(F.array_sort(F.collect_set(F.struct("n", "part"))).alias("parts"))
    return whole.select(F.col("id").alias("k_id"), F.col("key").alias("k_key"), F.flatten(F.transform("parts", lambda x: x["part"])).alias("ids"))


def decoded(ids: Column, model: str = MODEL) -> Column:
    """Texts of piece ids; null for null."""

    @F.arrow_udf("string")
    def decode(column: pa.Array) -> pa.Array:
        return _texts_of(pieces(model), column)

    return decode(ids)


def encoded_documents(docs: DataFrame, id_column: str = "doc_id", model: str = MODEL) -> DataFrame:
    """Every row of docs with piece_ids and n_pieces behind its columns."""
    out = encoded(docs, id_column, model)
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns], F.col("ids").alias("piece_ids"), F.size("ids").cast("long").alias("n_pieces"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document the number and digest of its ids, and whether decoding them gives back the text."""
    back = encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), back=True)
    plain = F.translate(F.coalesce(F.col("row.text"), F.lit("")), SPACE, " ")
    plain = F.when(F.contains(F.col("row.text"), F.lit(SPACE)), plain).otherwise(F.coalesce(F.col("row.text"), F.lit("")))
    return back.select(
        "row.doc_id", F.size("ids").cast("long").alias("n_pieces"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        (F.col("back") == plain).alias("round_trip"),
    )


def queries() -> dict:
    return {"op10_sentencepiece": op10_sentencepiece}


def oracle_sql() -> dict:
    return {}
