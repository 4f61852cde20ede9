"""Secret scans: patterns over texts and over every layer that can be decoded out of them.

A worklist holds layers of a text. Each layer is scanned; then its encoded parts are unwrapped (percent escapes, backslash-u, backslash-U
and backslash-x escapes, base64 and compressed data in base64) and the results join the list, until nothing new appears. A
layer whose characters were seen before for the same stretches of the text is not taken again, so cycles end. Every layer knows, for each of its
characters, which stretch of the outermost text it came from, and spans found in it are mapped there; a span in a base64 part
is the whole part. Base64 may touch other characters of its alphabet, and hold UTF-16. Base64 that is wrapped over lines is one part, from its first line to its last; compressed data may have
several members.

Base spans of the text itself always stay. Spans from layers are added unless they are already there.

Rules for odd rows: a null text is an empty one; an empty text has no spans; texts of any length are scanned whole; rows are
independent of one another, so repeated rows, empty tables and further columns need no rule. Of a compressed part that unfolds
to more than UNPACKED bytes (it may be a bomb) all is scanned in pieces, but what is encoded in it once more is not unwrapped; such
a row is marked in ``oversize``. Bytes that are no UTF-8 don't end a layer.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

KINDS = ("assign", "access", "hex")
#: Letters of the keyword in either case, of ASCII only; the value is group 2. Short matches are dropped after matching.
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
#: A run that is too short can't hold a longer one, so the least lengths stand in these patterns.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
MIN_VALUE = 6
#: Most bytes that one compressed part may unfold to.
UNPACKED = 64 << 20
#: Bytes of a piece of a larger part, and how much of one piece is read again with the next.
PIECE, OVERLAP = 1 << 20, 1 << 16

_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"\\U[0-9A-Fa-f]{8}|\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|\\u\{[0-9A-Fa-f]{1,6}\}")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{12,}={0,2}")
#: Base64 characters over two or more lines, which may be indented; the second pattern finds the characters of a line.
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:\r?\n[\x20\t]*+[A-Za-z0-9+/_-]++)+={0,2}")
_CHUNK = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
#: Least characters of a base64 part: 12 hold 9 bytes, and the shortest span has 12.
MIN_PART = 12
_ASCII = re.compile(rb"[\t\n\r\x20-\x7E]{12}")
_PRINTED = re.compile(rb"(?:\x00?[\t\n\r\x20-\x7E]){12,}")
#: Different bytes of such a run, where a part is not read from its first character.
LEAST_LETTERS = 10
#: The same in UTF-16 of either order.
_WIDE = ((re.compile(rb"(?:[\t\n\r\x20-\x7E]\x00){12}"), "utf-16-le"), (re.compile(rb"(?:\x00[\t\n\r\x20-\x7E]){12}"), "utf-16-be"))
#: The URL-safe letters as the standard ones; and how compressed data begins.
_STANDARD = str.maketrans("-_", "+/")
_HEAD = re.compile(rb"\x1f\x8b\x08|x[\x01\x5e\x9c\xda]|BZh[1-9]|\xfd7zXZ\x00")

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) of every pattern's matches, each kind leftmost and without overlap."""
    found = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_VALUE]
    found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return found


class Layer:
    """A decoded text with the outer stretch of each character: a list of begins and ends, or one stretch for all (two numbers).
    The outermost layer has none and is its own map."""

    __slots__ = ("text", "starts", "ends")

    def __init__(self, text: str, starts: list[int] | int | None = None, ends: list[int] | int | None = None):
        self.text, self.starts, self.ends = text, starts, ends

    def outer(self, start: int, end: int) -> tuple[int, int]:
        if self.starts is None:
            return start, end
        if isinstance(self.starts, int):
            return self.starts, self.ends
        return min(self.starts[start:end]), max(self.ends[start:end])

    def key(self) -> tuple:
        """The characters (their digest) and their stretches; one stretch for all counts once."""
        digest = hashlib.sha256(self.text.encode("utf-8", "surrogatepass")).digest()
        if isinstance(self.starts, int):
            return digest, self.starts, self.ends
        if self.text and self.starts.count(self.starts[0]) == self.ends.count(self.ends[0]) == len(self.text):
            return digest, self.starts[0], self.ends[0]
        return digest, tuple(self.starts), tuple(self.ends)

    def rewritten(self, pieces: Iterable[tuple[int, int, list[tuple[str, int, int]]]]) -> Layer:
        """The layer with each stretch (start, end) replaced by characters, which bring their stretch of this layer."""
        text: list[str] = []
        starts: list[int] = []
        ends: list[int] = []
        one = isinstance(self.starts, int)

        def copy(a: int, b: int) -> None:
            text.append(self.text[a:b])
            if not one:
                starts.extend(range(a, b) if self.starts is None else self.starts[a:b])
                ends.extend(range(a + 1, b + 1) if self.ends is None else self.ends[a:b])

        at = 0
        for a, b, chars in pieces:
            copy(at, a)
            if one:
                text.append("".join(c for c, _, _ in chars))
            else:
                for c, x, y in chars:
                    s, e = self.outer(x, y)
                    text.append(c)
                    starts.append(s)
                    ends.append(e)
            at = b
        copy(at, len(self.text))
        return Layer("".join(text), self.starts, self.ends) if one else Layer("".join(text), starts, ends)


def _percent(layer: Layer) -> Layer | None:
    pieces = []
    for m in _PERCENT.finditer(layer.text):
        raw = bytes.fromhex(m[0].replace("%", ""))
        chars, at = [], 0
        while at < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    chars.append((raw[at : at + n].decode(), m.start() + 3 * at, m.start() + 3 * (at + n)))
                    break
                except UnicodeDecodeError:
                    continue
            else:  # no character: its escape stays as it is
                n = 1
                chars += [(c, m.start() + 3 * at + i, m.start() + 3 * at + i + 1) for i, c in enumerate(m[0][3 * at : 3 * at + 3])]
            at += n
        pieces.append((m.start(), m.end(), chars))
    return layer.rewritten(pieces) if pieces else None


def _escapes(layer: Layer) -> Layer | None:
    pieces, half = [], None
    for m in _ESCAPE.finditer(layer.text):
        code = int(m[0][2:].strip("{}"), 16)
        if half and 0xDC00 <= code < 0xE000 and half[1] == m.start():
            code, start = 0x10000 + ((half[2] - 0xD800) << 10) + code - 0xDC00, half[0]
        else:
            start = m.start()
        half = (m.start(), m.end(), code) if 0xD800 <= code < 0xDC00 else None
        if code < 0xD800 or 0xE000 <= code < 0x110000:
            pieces.append((start, m.end(), [(chr(code), start, m.end())]))
    return layer.rewritten(pieces) if pieces else None


class Oversize(Exception):
    """A compressed part unfolds to more than UNPACKED bytes; the argument is the part's bytes."""


#: First bytes of compressed data, and what unfolds it.
_FORMS = (
    (b"\x1f\x8b", lambda: zlib.decompressobj(31)), (b"x", lambda: zlib.decompressobj(15)),
    (b"BZh", bz2.BZ2Decompressor), (b"\xfd7zXZ", lzma.LZMADecompressor),
)


def _stream(data: bytes) -> Iterator[bytes]:
    """Compressed data unfolded in pieces of at most PIECE bytes, over all members."""
    for head, opened in _FORMS:
        while data.startswith(head):
            one, feed = opened(), data
            try:
                while not one.eof:
                    out = one.decompress(feed, PIECE)
                    feed = getattr(one, "unconsumed_tail", b"")
                    if not out and not feed:
                        return
                    yield out
            except (zlib.error, OSError, lzma.LZMAError, EOFError):
                return
            data = one.unused_data.lstrip(b"\0")


def streamed_kinds(data: bytes) -> set[str]:
    """Kinds of base spans in data that is too large to hold; pieces overlap by OVERLAP characters."""
    kinds, rest = set(), ""
    for piece in _stream(data):
        text = rest + piece.decode("latin-1")
        kinds |= {k for k, _, _ in base_spans(text)}
        rest = text[-OVERLAP:]
    return kinds


def _unpacked(data: bytes) -> bytes | None:
    """Gzip, zlib, bzip2 or xz data unfolded; None if it is none of them."""
    whole = data
    for head, opened in _FORMS:
        if data.startswith(head):
            out, size = [], 0
            while data.startswith(head):
                try:
                    one = opened()
                    out.append(one.decompress(data, UNPACKED + 1 - size))
                except (zlib.error, OSError, lzma.LZMAError, EOFError):
                    break  # members before a broken one stay
                size += len(out[-1])
                if size > UNPACKED:
                    raise Oversize(whole)
                data = one.unused_data.lstrip(b"\0")
            if out:
                return b"".join(out)
    return None


def _readable(data: bytes) -> Iterator[str]:
    """The bytes as text: as UTF-8 (what is none becomes U+FFFD) if a run of ASCII is as long as the shortest span (12), and as
    UTF-16 of either order if such a run is."""
    if _ASCII.search(data):
        yield data.decode("utf-8", "replace")
    for form, name in _WIDE:
        # Two runs may begin at different parities.
        for parity in sorted({m.start() % 2 for m in form.finditer(data)}):
            yield data[parity : len(data) - (len(data) - parity) % 2].decode(name, "replace")


def _opens(data: memoryview, at: int, opened: Callable) -> bool:
    """Whether compressed data may begin there: its first bytes unfold without an error."""
    try:
        opened().decompress(data[at : at + 512], 1)
    except (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError):
        return False
    return True


def _base64(text: str) -> Iterator[bytes]:
    """What a run of base64 characters may stand for: compressed data in it unfolded, and all of it as it is.

    Encoded data may touch other characters of the alphabet (a key before it, a path around it), so the run is decoded from each
    of its first four characters: one of the four meets the data wherever it begins. Compressed data is looked for by its first
    bytes.
    """
    body = text.rstrip("=").translate(_STANDARD)
    for shift in range(4):
        part = body[shift : len(body) - ((len(body) - shift) % 4 == 1)]
        if len(part) < MIN_PART:
            continue
        data = base64.b64decode(part + "=" * (-len(part) % 4))
        # Read from another character, encoded repetitions of a few bytes look like other repetitions: those are no text.
        view = memoryview(data)
        packed = any(data.startswith(head) and _opens(view, 0, opened) for head, opened in _FORMS)
        if not packed and (not shift or any(len(set(m[0])) >= LEAST_LETTERS for m in _PRINTED.finditer(data))):
            yield data
        for m in _HEAD.finditer(data):
            if any(data.startswith(head, m.start()) and _opens(view, m.start(), opened) for head, opened in _FORMS):
                inner, met = data[m.start() :], set()
                while (inner := _unpacked(inner)) is not None and (key := hashlib.sha256(inner).digest()) not in met:
                    met.add(key)
                    yield inner


def _wrapped(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, characters) of what may be wrapped base64.

    That is each whole run of lines, and in a run each stretch of lines of one width, with or without the line before it (which
    may begin in the middle) and a shorter line after it; so lines before and after a part that look like base64 do no harm.
    """
    for run in _WRAPPED.finditer(text):
        chunks = [(m.start(), m.end(), m[0]) for m in _CHUNK.finditer(text, run.start(), run.end())]
        found, at = {(0, len(chunks))}, 0
        while at < len(chunks):
            width, end = len(chunks[at][2]), at + 1
            while end < len(chunks) and len(chunks[end][2]) == width:
                end += 1
            if width >= MIN_PART:
                ends = [end, end + 1] if end < len(chunks) and len(chunks[end][2]) < width else [end]
                found.update((a, b) for a in {at, max(at - 1, 0)} for b in ends)
            at = end
        for a, b in sorted(found):
            part = "".join(c for _, _, c in chunks[a:b])
            if b - a > 1 and len(part) >= MIN_PART:
                yield chunks[a][0], chunks[b - 1][1], part


def all_spans(text: str) -> tuple[list[Span], list[Span], bool]:
    """(base spans, all spans, whether a part was too large to unfold), each list by start, then kind, then end."""
    base = base_spans(text)
    order = lambda s: (s[1], KINDS.index(s[0]), s[2])
    found, oversize = set(base), False
    if "%" in text or "\\" in text or _BASE64.search(text) or _WRAPPED.search(text):
        todo, seen = [Layer(text)], set()
        while todo:
            layer = todo.pop()
            if layer.starts is not None:
                found.update((kind, *layer.outer(a, b)) for kind, a, b in base_spans(layer.text))
            rewritten = (_percent(layer) if "%" in layer.text else None, _escapes(layer) if "\\" in layer.text else None)
            inner = [(x.key(), x) for x in rewritten if x is not None]
            for start, end, part in chain(((m.start(), m.end(), m[0]) for m in _BASE64.finditer(layer.text)), _wrapped(layer.text)):
                a, b = layer.outer(start, end)
                try:
                    for data in _base64(part):
                        inner += [((y := Layer(plain, a, b)).key(), y) for plain in _readable(data)]
                except Oversize as e:
                    oversize = True
                    found.update((kind, a, b) for kind in streamed_kinds(e.args[0]))
            for key, x in inner:
                if key not in seen:
                    seen.add(key)
                    todo.append(x)
    return sorted(base, key=order), sorted(found, key=order), oversize


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


RESULT = "n_assign long, n_access long, n_hex long, base string, spans string, oversize boolean"


def scan(text: Column) -> Column:
    """A struct of RESULT for each text. base and spans list kind:start:end in code points, the end exclusive."""

    @F.pandas_udf(RESULT)
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            base, found, oversize = all_spans(t or "")
            counts = [sum(s[0] == k for s in base) for k in KINDS]
            rows.append((*counts, joined(base), joined(found), oversize))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")])

    return run(text)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "documents").select("doc_id", scan(F.col("text")).alias("s"))
    return out.select("doc_id", "s.n_assign", "s.n_access", "s.n_hex", F.sha2(F.col("s.base"), 256).alias("base_sha256"), "s.spans", "s.oversize")


def base_sha256(text: str) -> str:
    """What the query holds in base_sha256 for a text."""
    return hashlib.sha256(joined(all_spans(text)[0]).encode()).hexdigest()


def queries() -> dict:
    return {"op9_secrets": op9_secrets}


def oracle_sql() -> dict:
    return {}
