"""Filter audit and Merkle manifest against plain Python, on odd rows too."""

import hashlib
import re
import zlib
from collections import defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import filter_audit, merkle

LABELS = "doc_id long, quality int, toxic int, source string, part string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def masks(rows, order_of):
    texts = defaultdict(list)
    for r in rows:
        texts[r["text"] or ""].append(order_of(r))
    out = []
    for r in rows:
        t = r["text"] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": min(texts[t]) < order_of(r),
        }
        out.append({k for k, v in fails.items() if v})
    return out


def plain_audit(rows, labels):
    order_of = lambda r: 2**63 if r["doc_id"] is None else r["doc_id"]
    good, toxic = {l[0] for l in labels if l[1] == 1}, {l[0] for l in labels if l[2] == 1}
    found = defaultdict(lambda: [0] * 6)
    removed = defaultdict(int)
    for r, fails in zip(rows, masks(rows, order_of), strict=True):
        part = r["source"] or ""
        for order in map("".join, permutations("ABCDE")):
            for step, name in enumerate(order, 1):
                now, before = name in fails, bool(fails & set(order[: step - 1]))
                has_id = r["doc_id"] is not None
                counts = [not now and not before, now and not before, now and before, fails == {name}, now and not before and has_id and r["doc_id"] in good, now and not before and has_id and r["doc_id"] in toxic]
                cell = found[part, order, step]
                for i, c in enumerate(counts):
                    cell[i] += c
                removed[part, name] += counts[1]
    return {(*k, *v, removed[k[0], k[1][k[2] - 1]]) for k, v in found.items()}


def audited(docs, labels):
    return {tuple(r) for r in filter_audit.audit(docs, labels).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect()}


def test_audit_of_odd_rows(spark, odd, empty):
    labels = [(1, 1, 0), (1, 0, 1), (6, 1, 1), (7, 1, None), (7, None, 1), (None, 1, 1), (20, 1, 0), (99, 1, 1)]
    frame = spark.createDataFrame([(*l, "x", "y") for l in labels], LABELS)
    rows = [r.asDict() for r in odd.collect()]
    assert audited(odd, frame) == plain_audit(rows, labels)
    assert audited(empty, frame) == set()
    assert audited(odd, frame.limit(0)) == plain_audit(rows, [])


def test_audit_of_copies_and_repeated_rows(spark):
    long = "word " * 60
    rows = [(5, long, "a"), (5, long, "a"), (3, long, "b"), (3, long, "b"), (3, long, "a"), (None, long, None), (4, "SHOUT " * 50, ""), (9, "SHOUT " * 50, "a"), (None, "alone # here", "a"), (None, "alone # here", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    labels = [(3, 1, 0), (5, 0, 1), (9, 1, 1)]
    found = audited(docs, spark.createDataFrame([(*l, "", "") for l in labels], LABELS))
    assert found == plain_audit([dict(zip(("doc_id", "text", "source"), r, strict=True)) for r in rows], labels)
    assert len(found) == 3 * 600


def test_audit_metrics_add_up(spark, odd):
    for part, order, step, kept, removed, redundant, unique, *_ in audited(odd, spark.createDataFrame([], LABELS)):
        assert kept >= 0 and unique <= removed + redundant and (step > 1 or redundant == 0)


def plain_leaf(r):
    values = [r[c] for c in ("doc_id", "source", "lang", "n_chars", "text")]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(nodes):
    """(top, each node's siblings from the bottom up as (left, right))."""
    proofs, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for proof, i in zip(proofs, range(len(nodes)), strict=True):
            run = level[at[i] // 16 * 16 :][:16]
            proof.append(("".join(run[: at[i] % 16]), "".join(run[at[i] % 16 + 1 :])))
            at[i] //= 16
        level = [sha("".join(level[k : k + 16])) for k in range(0, len(level), 16)]
    return level[0], proofs


def plain_manifest(rows):
    sources = sorted({r["source"] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in sources:
        own = sorted((r for r in rows if r["source"] == s), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r)))
        trees.append((own, *plain_tree([plain_leaf(r) for r in own])))
    root, upper = plain_tree([t[1] for t in trees])
    out = []
    for (own, subroot, proofs), over in zip(trees, upper, strict=True):
        for r, proof in zip(own, proofs, strict=True):
            whole, leaf = proof + over, plain_leaf(r)
            fold = leaf
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and r["text"] is not None:
                fold = plain_leaf({**r, "text": re.sub("[A-Z]", lambda m: m[0].lower(), r["text"])})
            for left, right in whole:
                fold = sha(left + fold + right)
            out.append((r["doc_id"] if r["doc_id"] is not None else -1, leaf, subroot, root, sha("".join(a + b for a, b in whole)), fold, fold == root))
    return sorted(out)


def manifested(docs):
    rows = merkle.manifest(docs)
    rows = rows.withColumn("fold", merkle.folded(F.coalesce("tampered_leaf", "leaf"), F.col("proof")))
    rows = rows.select(F.coalesce("doc_id", F.lit(-1)), "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")), "fold", F.col("fold") == F.col("root"))
    return sorted(tuple(r) for r in rows.collect())


def test_manifest_of_odd_rows(odd, empty):
    assert manifested(odd) == plain_manifest([r.asDict() for r in odd.collect()])
    assert manifested(empty) == []


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 40}, {"a": 1, None: 1}, {None: 17, "": 16, "é": 257, "z": 1, "Z": 300}, {f"s{k}": 1 + k % 3 for k in range(40)}])
def test_manifest_of_trees_of_every_height(spark, sizes):
    rows = [(100 * k + i, s, "en" if i % 2 else None, i, f"Text {i} of {s}" if i % 7 else None) for k, (s, n) in enumerate(sizes.items()) for i in range(n)]
    names = ("doc_id", "source", "lang", "n_chars", "text")
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert manifested(docs) == plain_manifest([dict(zip(names, r, strict=True)) for r in rows])


def test_changed_rows_are_found(spark):
    rows = [(i, "s", "en", 1, f"Row {i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    found = merkle.manifest(docs).withColumn("ok", merkle.folded(F.coalesce("tampered_leaf", "leaf"), F.col("proof")) == F.col("root")).collect()
    assert {r.doc_id for r in found if not r.ok} == {i for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 0}
