"""Suffix-array dedup: arrays and common prefixes against plain sorting, removed bytes against all windows."""

import random
from collections import Counter

import numpy as np
import pytest

from palimpsest.llm import suffix_dedup as sd


def random_text(rng, n, letters=b"ab"):
    raw = bytes(rng.choice(letters) for _ in range(n))
    cut = rng.randrange(n)
    return raw[:cut] + raw[cut // 2 : cut] + raw[cut:] if rng.random() < 0.7 else raw


@pytest.mark.parametrize("depth", [1, 3, 8, 37, 400])
def test_suffix_array(depth):
    rng = random.Random(depth)
    for n in (1, 2, 7, 60, 300):
        for letters in (b"a", b"ab", bytes(range(256))):
            text = random_text(rng, n, letters)
            expected = sorted(range(len(text)), key=lambda i: (text[i : i + depth], i))  # noqa: B023
            assert sd.suffix_array(np.frombuffer(text, np.uint8), depth).tolist() == expected


def test_suffix_array_of_more_than_two_million_bytes():
    text = np.frombuffer(b"abcab" * 430_000, np.uint8)
    order = sd.suffix_array(text, 12)
    keys = {k: bytes(text[k : k + 12]) for k in order[:: 50_000].tolist()}
    assert list(keys.values()) == sorted(keys.values()) and len(np.unique(order)) == len(text)


def test_common_prefixes():
    rng = random.Random(3)
    for _ in range(60):
        raws = [random_text(rng, rng.randint(1, 60)) for _ in range(rng.randint(1, 5))]
        text = np.frombuffer(b"".join(raws), np.uint8)
        ends = np.cumsum([len(r) for r in raws])
        limit = np.repeat(ends, [len(r) for r in raws])
        order = sd.suffix_array(text, 400)
        order = order[np.array([rng.random() < 0.8 for _ in order])]
        found = sd.common_prefixes(text, order, limit)
        for x, y, k in zip(order[:-1].tolist(), order[1:].tolist(), found.tolist(), strict=True):
            a, b = bytes(text[x : limit[x]]), bytes(text[y : limit[y]])
            assert a[:k] == b[:k] and (k == min(len(a), len(b)) or a[k] != b[k])


def test_merging_by_binary_search():
    rng = random.Random(8)
    for _ in range(50):
        parts = [sorted(rng.sample(range(300), rng.randint(0, 80))) for _ in range(2)]
        a, b = (np.array([x.to_bytes(16, "little") for x in p], "S16") for p in parts)
        whole, both = sd.merged(np.sort(a), np.sort(b))
        assert sorted(set(whole.tolist())) == whole.tolist() and set(whole.tolist()) == set(a.tolist()) | set(b.tolist())
        assert set(both.tolist()) == set(a.tolist()) & set(b.tolist())


def plain(rows, window):
    raws = [(t or "").encode() for _, t in rows]
    seen = Counter(r[i : i + window] for r in raws for i in range(len(r) - window + 1))
    out = []
    for (doc, _), r in zip(rows, raws, strict=True):
        gone = bytearray(len(r))
        for i in range(len(r) - window + 1):
            if seen[r[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        kept = bytes(x for x, g in zip(r, gone, strict=True) if not g)
        spans = sum(g and (not k or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((doc if doc is not None else -1, len(r), sum(gone), spans, kept))
    return sorted(out)


def found(docs, **sizes):
    return sorted((r[0] if r[0] is not None else -1, r[1], r[2], r[3], bytes(r[4])) for r in sd.dedup_bytes(docs, **sizes).collect())


# Parts of 40 bytes deal nearly every anchor to several shards; whole anchors stay in one with the usual sizes.
@pytest.mark.parametrize("sizes", [{"part_bytes": 40, "shard_bytes": 100}, {"part_bytes": 150, "shard_bytes": 60}, {}])
def test_removed_bytes(spark, sizes):
    rng = random.Random(11)
    words = ["alpha", "beta", "gamma", "é", "delta", "世界", "e", "zeta"]
    passage = " ".join(rng.choice(words) for _ in range(14))
    rows = [(None if k % 17 == 0 else k // 2, " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))) for k in range(60)]
    rows = [(i, f"{t[: len(t) // 2]} {passage} {t[len(t) // 2 :]}" if k % 3 == 0 else t) for k, (i, t) in enumerate(rows)]
    rows += [rows[5], rows[6], (99, None), (98, ""), (97, "a" * 90), (96, "ab" * 30 + "c")]
    docs = spark.createDataFrame([(i, t, 1, b"x") for i, t in rows], "doc_id long, text string, at int, digest binary")
    assert found(docs, window=24, anchor=8, **sizes) == plain(rows, 24)


def test_odd_rows(odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert found(odd) == plain(rows, sd.WINDOW)
    assert found(empty) == []
