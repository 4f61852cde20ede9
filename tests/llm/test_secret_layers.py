"""Secrets in encoded parts that repeat, are wrapped over lines or have several compressed members."""

import base64
import bz2
import gzip
import lzma
import random
import zlib

import pytest

from palimpsest.llm import secret_scan

INNER = b"secret=abcdef123?>"


def test_repeated_parts_are_all_found():
    parts = [base64.b64encode(INNER).decode(), base64.urlsafe_b64encode(INNER).decode(), base64.b64encode(gzip.compress(INNER)).decode(), base64.b64encode(INNER).decode()]
    text = "a " + " b ".join(parts) + " %41"
    want, at = [], 2
    for p in parts:
        want.append(("assign", at, at + len(p)))
        at += len(p) + 3
    assert secret_scan.all_spans(text)[1] == want


def filler(n):
    rng = random.Random(n)
    return " ".join("".join(rng.choices("bcdghijklm", k=6)) for _ in range(n)).encode()


@pytest.mark.parametrize("width", (64, 76))
@pytest.mark.parametrize("lines", ("{}", "-----BEGIN PRIVATE-----\n{}\n-----END PRIVATE-----", "word\n{}\nword", "data: {}", "a\n\n{}\n\nb"))
@pytest.mark.parametrize("packed", (bytes, gzip.compress, lzma.compress))
def test_wrapped_base64(width, lines, packed):
    data = base64.b64encode(packed(b"x" * (width * 3 // 4 - 9) + b" " + INNER + b" " + filler(40))).decode()
    for end in ("\n", "\r\n", "\n    "):
        part = end.join(data[i : i + width] for i in range(0, len(data), width))
        text = lines.format(part)
        start = text.index(part)
        assert ("assign", start, start + len(part)) in secret_scan.all_spans(text)[1]


@pytest.mark.parametrize("packed", (gzip.compress, bz2.compress, lzma.compress, zlib.compress))
def test_later_members(packed):
    data = base64.b64encode(packed(b"nothing ") + packed(b"here ") + packed(INNER)).decode()
    assert secret_scan.all_spans(f"x {data}")[1] == [("assign", 2, 2 + len(data))]


def test_random_nesting_and_repetition():
    """Planted parts, encoded one to four times, repeated and next to one another, are all found; fillers give nothing."""
    rng = random.Random(11)
    steps = (
        lambda x: base64.b64encode(x), lambda x: base64.urlsafe_b64encode(x), lambda x: base64.b64encode(gzip.compress(x)),
        lambda x: base64.b64encode(zlib.compress(bz2.compress(x))), lambda x: b"".join(b"%%%02X" % c for c in x), lambda x: b"".join(b"\\x%02x" % c for c in x),
        lambda x: base64.b64encode(gzip.compress(b"first ") + gzip.compress(x)), lambda x: base64.b64encode(b"\x00\xff\x01 " + x),
    )
    for _ in range(500):
        text, want = "", []
        for _ in range(rng.randrange(4)):
            text += filler(rng.randrange(1, 9)).decode() + " "
            part = rng.choice((INNER, b"AKIA" + b"Z9" * 9, b"deadbeef" * 4))
            for _ in range(rng.randrange(1, 5)):
                part = rng.choice(steps)(part)
            for _ in range(rng.randrange(1, 3)):
                want.append((len(text), len(text) + len(part)))
                text += part.decode() + " ; "
        found = {(a, b) for _, a, b in secret_scan.all_spans(text)[1]}
        assert all(any(a <= x and y <= b for x, y in found) for a, b in want), text
        assert want or not found


def test_deep_layers_and_large_parts():
    data = b"see " + INNER
    for _ in range(1100):
        data = zlib.compress(data, 1)
    assert [k for k, _, _ in secret_scan.all_spans("x " + base64.b64encode(data).decode())[1]] == ["assign"]
    big = bytes(secret_scan.UNPACKED) + b"\n" + INNER + bytes(1000)
    for packed in (zlib.compress, bz2.compress, lzma.compress):
        _, found, oversize = secret_scan.all_spans("x " + base64.b64encode(packed(big)).decode())
        assert oversize and [k for k, _, _ in found] == ["assign"]


@pytest.mark.parametrize("before", ("id_", "a", "ab", "abc", "-", "https://h/x/", "key=", "x+y/"))
@pytest.mark.parametrize("after", ("", "-x", "/tail/more", "_", "zz"))
@pytest.mark.parametrize("packed", (bytes, gzip.compress, bz2.compress, zlib.compress, lzma.compress))
def test_base64_that_touches_its_alphabet(before, after, packed):
    """Encoded parts are found wherever they begin in a run of base64 characters; the span is the run."""
    part = base64.b64encode(packed(b"password=hunter22secret and more words")).decode().rstrip("=")
    text = f"see {before}{part}{after} end"
    kinds = [s for s in secret_scan.all_spans(text)[1] if s[0] == "assign"]
    start = text.index(part)
    assert any(a <= start and b >= start + len(part) for _, a, b in kinds), text


@pytest.mark.parametrize("code", ("utf-16-le", "utf-16-be", "utf-16"))
def test_utf_16_in_base64(code):
    for pad in (b"", b"z"):
        part = base64.b64encode(pad + "token: abcdef12345".encode(code)).decode()
        assert secret_scan.all_spans(f"x {part} y")[1] == [("assign", 2, 2 + len(part))]


def test_eight_digit_escapes():
    text = "".join(f"\\U{ord(c):08x}" for c in "secret=abcdefg")
    assert secret_scan.all_spans(text)[1] == [("assign", 0, len(text))]


def test_large_layers_hold_one_stretch():
    """A part that unfolds to some megabytes has two numbers for all of its characters, also where it is encoded once more."""
    inner = base64.b64encode(b"secret=abcdef123 and more").decode()
    part = base64.b64encode(gzip.compress(b"filler words %41 " * 200_000 + inner.encode())).decode()
    assert secret_scan.all_spans(f"x {part}")[1] == [("assign", 2, 2 + len(part))]
    layer = secret_scan.Layer("a%41b" * 10, 3, 9)
    assert secret_scan._percent(layer).starts == 3 and secret_scan._percent(layer).text == "aAb" * 10 and layer.outer(4, 5) == (3, 9)
