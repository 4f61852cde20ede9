"""Media columns: Ogg files as binary columns, written and read in Arrow batches.

Writing lays a payload of 8-bit samples into two logical streams, whose packets of 576 samples take turns: packets 0, 2, 4 ...
belong to stream 1, packets 1, 3, 5 ... to stream 2. Each stream starts with a header packet, its pages carry a checksum, a
sequence number and the granule position (samples of that stream up to the last packet that ends on the page). Reading walks
the pages, verifies their checksums, splits them by serial number, puts packets together from lacing values, also over page
ends, interleaves the packets again and derives each stream's time from its last granule position.

Rules for odd rows: a null text is an empty one; an empty text is one packet of padding; a binary column that is null gives
nulls, and one that is no Ogg file, or whose pages fail their checksum, gives an ``error`` instead of values; equal texts give
equal bytes; rows are independent of one another, so repeated rows, empty tables and further columns need no rule.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of

PACKET = 576
PAD = 255
RATE = 8000
SERIALS = (1, 2)
#: Packets on a data page: 64 * 576 bytes fit in 255 lacing values of at most 255 bytes.
PAGE_PACKETS = 64
CAPTURE = b"OggS"
#: Header packet of a stream: name, version, channels, rate, samples in a packet, stream's place, number of streams.
HEAD = struct.Struct("<8sBBIHBB")
HEAD_NAME = b"samples8"
_PAGE = struct.Struct("<4sBBqIII")
_MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def page_checksum(page: bytes) -> int:
    """CRC-32 with polynomial 0x04C11DB7, most significant bit first, from zero: zlib's, which goes by the least significant
    bit first, over mirrored bytes, mirrored back."""
    return int(f"{zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF:032b}"[::-1], 2)


def _page(kind: int, granule: int, serial: int, number: int, packets: list[bytes]) -> bytes:
    lacing = bytearray()
    for p in packets:
        lacing += b"\xff" * (len(p) // 255) + bytes([len(p) % 255])
    head = _PAGE.pack(CAPTURE, 0, kind, granule, serial, number, 0) + bytes([len(lacing)]) + lacing
    page = head + b"".join(packets)
    return page[:22] + struct.pack("<I", page_checksum(page)) + page[26:]


def padded(data: bytes) -> bytes:
    """The bytes and padding up to a positive multiple of a packet."""
    return data + bytes([PAD]) * (max(PACKET, -(-len(data) // PACKET) * PACKET) - len(data))


def write_ogg(payload: bytes) -> bytes:
    """An Ogg file of the payload, whose length is a positive multiple of PACKET."""
    packets = [payload[i : i + PACKET] for i in range(0, len(payload), PACKET)]
    streams = [packets[i :: len(SERIALS)] for i in range(len(SERIALS))]
    out = [_page(2, 0, serial, 0, [HEAD.pack(HEAD_NAME, 1, 1, RATE, PACKET, i, len(SERIALS))]) for i, serial in enumerate(SERIALS)]
    pages = [max(1, -(-len(s) // PAGE_PACKETS)) for s in streams]
    for n in range(max(pages)):
        for serial, stream, last in zip(SERIALS, streams, pages, strict=True):
            if n < last:
                part = stream[n * PAGE_PACKETS : (n + 1) * PAGE_PACKETS]
                out.append(_page(4 if n == last - 1 else 0, (n * PAGE_PACKETS + len(part)) * PACKET, serial, n + 1, part))
    return b"".join(out)


def pages_of(media: bytes) -> Iterator[tuple[int, int, int, int, bytes, bytes]]:
    """(kind, granule, serial, number, lacing, body) of each page; raises ValueError on damage."""
    at = 0
    while at < len(media):
        if len(media) < at + 27 or media[at : at + 4] != CAPTURE:
            raise ValueError(f"no page at {at}")
        _, version, kind, granule, serial, number, checksum = _PAGE.unpack_from(media, at)
        lacing = media[at + 27 : at + 27 + media[at + 26]]
        body = at + 27 + len(lacing)
        end = body + sum(lacing)
        if version or len(lacing) < media[at + 26] or end > len(media):
            raise ValueError(f"page at {at} is cut short")
        if page_checksum(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != checksum:
            raise ValueError(f"checksum of the page at {at} fails")
        yield kind, granule, serial, number, lacing, media[body:end]
        at = end


def read_ogg(media: bytes) -> tuple[bytes, list[dict]]:
    """(payload, a record for each stream in order of appearance: serial, pages, packets, granule, rate, ms)."""
    streams: dict[int, dict] = {}
    for kind, granule, serial, number, lacing, body in pages_of(media):
        if kind & 2:
            if serial in streams:
                raise ValueError(f"stream {serial} begins twice")
            streams[serial] = {"serial": serial, "pages": 0, "granule": 0, "packets": [], "rest": b"", "ended": False}
        s = streams.get(serial)
        if s is None or s["ended"] or number != s["pages"] or bool(kind & 1) != bool(s["rest"]):
            raise ValueError(f"page {number} of stream {serial} is out of order")
        at = 0
        for n in lacing:
            s["rest"] += body[at : at + n]
            at += n
            if n < 255:
                s["packets"].append(s["rest"])
                s["rest"] = b""
        s |= {"pages": s["pages"] + 1, "granule": max(granule, s["granule"]), "ended": bool(kind & 4)}
    found, parts = [], []
    for s in streams.values():
        name, _, _, rate, per_packet, place, of = HEAD.unpack(s["packets"][0])
        data = s["packets"][1:]
        if name != HEAD_NAME or of != len(streams) or not s["ended"] or s["rest"] or s["granule"] != per_packet * len(data):
            raise ValueError(f"stream {s['serial']} is incomplete")
        parts.append((place, data))
        found.append({"serial": s["serial"], "pages": s["pages"], "packets": len(data), "granule": s["granule"], "rate": rate, "ms": s["granule"] * 1000 // rate})
    parts.sort(key=lambda p: p[0])
    joined = [b""] * sum(len(p) for _, p in parts)
    for place, data in parts:
        joined[place :: len(parts)] = data
    return b"".join(joined), found


def sample_features(payload: bytes, streams: list[dict]) -> str:
    """Times of the streams, then level, mean, span and sign changes of the samples about 128."""
    x = np.frombuffer(payload, np.uint8).astype(np.int16) - 128
    loud = int(np.sqrt(float(np.dot(x.astype(np.int64), x.astype(np.int64))) / len(x)) * 1000)
    times = ",".join(f"{s['serial']}:{s['packets']}:{s['ms']}" for s in streams)
    return f"streams={times};rms={loud};mean={int(x.sum(dtype=np.int64)) * 1000 // len(x)};min={x.min()};max={x.max()};turns={int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))}"


def to_ogg(text: Column) -> Column:
    """The texts' bytes, padded, as Ogg files."""

    @F.pandas_udf("binary")
    def write(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: write_ogg(padded((t or "").encode())))

    return write(text)


#: What reading gives; ``payload`` is left out unless it is asked for.
PROBE = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"


def _probe(media: bytes | None) -> dict:
    none = dict.fromkeys(name.split()[0] for name in PROBE.split(", "))
    if media is None:
        return none
    stored = {"media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest()}
    try:
        payload, streams = read_ogg(media)
    except (ValueError, struct.error, IndexError) as e:
        return none | stored | {"error": str(e)}
    return none | stored | {
        "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(),
        "tail_crc32": zlib.crc32(payload[-32:]), "feature": sample_features(payload, streams),
    }


def probe_ogg(media: Column) -> Column:
    """A struct of PROBE for each Ogg file."""

    @F.pandas_udf(PROBE)
    def probe(files: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_probe(f) for f in files], columns=[name.split()[0] for name in PROBE.split(", ")]).astype({"payload_bytes": "Int64", "tail_crc32": "Int64", "media_bytes": "Int64"})

    return probe(media)


def payload_of(media: Column) -> Column:
    """The payload of each Ogg file; null for null, an error for a damaged file."""

    @F.pandas_udf("binary")
    def read(files: pd.Series) -> pd.Series:
        return files.map(lambda f: None if f is None else read_ogg(f)[0])

    return read(media)


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length(text_of()).cast("long").alias("n_bytes"), to_ogg(text_of()).alias("media"))
    return docs.select("doc_id", "n_bytes", probe_ogg(F.col("media")).alias("p")).select("doc_id", "n_bytes", "p.*").drop("error")


def queries() -> dict:
    return {"op3_media": op3_media}


def oracle_sql() -> dict:
    return {}
