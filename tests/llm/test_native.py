"""Mixing, URL filters, quality rules and line dedup: against plain Python, and on odd rows."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import line_dedup, mixing, quality, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(t):
    return WORD.findall(t or "")


def plain_targets(sizes, weights=(3, 1, 2)):
    """Shares above twice a source's size are cut and the rest dealt again, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    left, target, open_ = 1.5 * sum(sizes.values()), {}, set(order)
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > 2 * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
            open_.discard(s)
        left = 1.5 * sum(sizes.values()) - sum(target.values())
    return target


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, " ".join(f"w{i}_{k}" for k in range((i * 37) % 900)), "s%d" % (i % 3 if i % 2 else 0) if i % 11 else None) for i in range(400)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string"), rows


def test_mix_meets_targets(corpus):
    docs, rows = corpus
    got = mixing.taken_words(docs).collect()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(words(t))
    want = plain_targets(dict(sizes))
    source = {i: s for i, _, s in rows}
    taken = Counter()
    for r in got:
        assert r.size == len(words(rows[r.doc_id][1])) and r.source_size == sizes[source[r.doc_id]]
        assert math.isclose(r.target, want[source[r.doc_id]], rel_tol=1e-9)
        assert 0 <= r.taken <= 2 * r.size
        taken[source[r.doc_id]] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.taken_words(docs).collect()))


def test_permutation_is_a_bijection(spark):
    for n in (1, 2, 3, 7, 64, 1000):
        rows = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5)).alias("p")).collect()
        assert sorted(r.p for r in rows) == list(range(n))


def test_permutation_spreads_over_large_ranges(spark):
    n = 10**11
    rows = spark.range(20000).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5)).alias("p")).collect()
    tenths = Counter(r.p * 10 // n for r in rows)
    assert len({r.p for r in rows}) == 20000 and all(0 <= r.p < n for r in rows)
    assert all(1700 < tenths[k] < 2300 for k in range(10))


def test_shard_counts_follow_targets(corpus):
    docs, _ = corpus
    _, slots = mixing.mix_plan(docs, block=16, shard=256)
    counts = {(r.shard, r.number): r["count"] for r in slots.groupBy("shard", "number").count().collect()}
    per = Counter()
    for (_, n), c in counts.items():
        per[n] += c
    shards = {s for s, _ in counts}
    full = [s for s in shards if sum(c for (x, _), c in counts.items() if x == s) == 256]
    assert len(full) >= len(shards) - 1
    for n, total in per.items():
        share = total / sum(per.values())
        for s in full:
            assert abs(counts.get((s, n), 0) - 256 * share) < 6 * math.sqrt(256 * share * (1 - share)) + 3


def test_mixed_documents_hold_what_is_taken(corpus):
    docs, rows = corpus
    taken = {r.doc_id: r.taken for r in mixing.taken_words(docs).collect()}
    got = Counter()
    for r in mixing.mixed_documents(docs).collect():
        own = words(rows[r.doc_id][1])
        assert set(words(r.text)) <= set(own) and len(words(r.text)) > 0
        got[r.doc_id] += len(words(r.text))
    assert {i: n for i, n in taken.items() if n} == dict(got)


def test_mixing_odd_rows(odd, empty, texts):
    got = mixing.taken_words(odd).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, len(words(t))) for i, t in texts)
    out = mixing.mixed_documents(odd)
    assert out.columns == odd.columns and out.count() > 0
    assert all(r.n_chars == len(r.text) for r in out.select("text", "n_chars").collect())
    assert mixing.taken_words(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


def plain_verdict(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h) + len(p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_url_filter(spark):
    urls = [
        None, "", "no scheme", "http://", "http://example.com", "http://Example.COM/en/x?y#z", "https://www.example.com/en/", "http://a.www.example.com/en/q",
        "http://x.net/es/1", "http://x.net/fr", "http://net/fr/", "http://notnet/fr/", "http://a..com/", "http://.com/", "a://b://c.com/", "http://É.com/EN/",
        "http://x.com?/en/", "http://x.com#/", "http://" + "a." * 300 + "net/es/" + "b/" * 300, "http://x.net/es/1",
    ]
    pages = spark.createDataFrame([(i, u, "v", "h") for i, u in enumerate(urls)] + [(3, "http://x.net/es/1", "v", "h")], "page_id long, url string, verdict string, host string")
    out = url_filter.judged(pages, url_filter.rules_frame(spark)).select("row.page_id", "row.url", "host", "path", "rule", "verdict").collect()
    assert len(out) == len(urls) + 1
    for r in out:
        assert (r.host, r.path, r.rule, r.verdict) == plain_verdict(r.url)
    nothing = spark.createDataFrame([], "host string, path string, verdict string")
    assert {r.verdict for r in url_filter.judged(pages, nothing).collect()} == {"allow"}
    assert url_filter.judged(pages.where("false"), url_filter.rules_frame(spark)).count() == 0


def test_rules_that_end_inside_a_segment(spark):
    rules = spark.createDataFrame([("x.com", "/ca", "block"), ("x.com", "", "allow"), ("x.com", "/case/a", "allow")], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "h://x.com/casino"), (2, "h://x.com/b"), (3, "h://y.x.com/case/abc")], "page_id long, url string")
    got = {r.row.page_id: (r.rule, r.verdict) for r in url_filter.judged(pages, rules, default="none").collect()}
    assert got == {1: ("x.com/ca", "block"), 2: ("x.com", "allow"), 3: ("x.com/case/a", "allow")}


def plain_features(t):
    w = words(t)
    lines = [x for x in (t or "").split("\n") if words(x)]
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_on_odd_rows(odd, empty, texts, spark):
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 0), (2, None, None), (3, 0, 0), (999, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality.judged(odd, labels).collect()
    assert Counter((r.id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == Counter((i, *plain_features(t)) for i, t in texts)
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert r.kept == (not r.base_failed)  # too few labels for any cutoff
    kept = quality.kept_documents(odd, labels)
    assert kept.columns == odd.columns and kept.count() == sum(r.kept for r in got)
    assert quality.judged(empty, labels).count() == 0 and quality.judged(empty, labels.where("false")).count() == 0


def test_binomial_tail(spark):
    for n, k, p in ((50, 0, 0.02), (300, 2, 0.02), (2000, 21, 0.02), (100000, 1900, 0.02), (40, 39, 0.02)):
        want = min(1.0, sum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log(1 - p)) for j in range(k + 1)))
        got = spark.range(1).select(quality.binomial_tail(F.lit(n).cast("long"), F.lit(k).cast("long"), p).alias("x")).first().x
        assert math.isclose(got, 1.0 if k >= n * p else want, rel_tol=1e-6)


def test_cutoffs_limit_false_rejection(spark):
    """Junk goes, good documents stay, in each stratum; a stratum without labels rejects nothing."""
    rows, labels = [], []
    for i in range(3000):
        good, lang = i % 3 > 0, "en" if i % 2 else "de"
        body = " ".join(f"w{i}x{k}" for k in range(40))
        rows.append((i, body if good else body.replace(" ", "*** "), lang))
        labels.append((i, int(good), 0))
    rows += [(5000 + i, ("q%d*** " % i) * 1 + " ".join(f"z{i}{k}***" for k in range(40)), "xx") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.id: r.kept for r in quality.judged(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    for lang_bit in (0, 1):
        good = [i for i in range(3000) if i % 3 > 0 and i % 2 == lang_bit]
        assert sum(not got[i] for i in good) <= quality.ALPHA * len(good)
        assert not any(got[i] for i in range(3000) if i % 3 == 0 and i % 2 == lang_bit)
    assert all(got[5000 + i] for i in range(5))


def test_strata_with_few_labels(spark):
    """47 good labels are enough for cutoffs, 30 are not, and both strata are listed."""
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(40)), "fr" if i < 47 else "de") for i in range(77)]
    rows += [(100 + i, " ".join(f"v{i}x{k}!" for k in range(40)), lang) for i, lang in enumerate(("fr", "de"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(77)], "doc_id long, quality int, toxic int")
    cut = {r.stratum: r for r in quality.cutoffs(quality.features(docs), labels).collect()}
    assert (cut["fr"].n, cut["de"].n) == (47, 30)
    assert cut["fr"].cut_exclamations == 0.05 and cut["de"].cut_exclamations is None
    got = {r.id: r.kept for r in quality.judged(docs, labels).collect()}
    assert not got[100] and got[101] and all(got[i] for i in range(77))


def plain_lines(rows, min_docs=10):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(lower)
    docs = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            docs[key(line)].add(i)
    gone = {k for k, d in docs.items() if len(k) >= 1 and len(d) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in gone]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def test_line_dedup(odd, empty, texts, spark):
    got = line_dedup.dedup_lines(odd).select("row.doc_id", "n_lines", "n_dropped", F.sha2("line_text", 256).alias("h")).collect()
    assert Counter(map(tuple, got)) == Counter(plain_lines(texts))
    assert sum(r.n_dropped for r in got) >= 14
    out = line_dedup.deduplicated_documents(odd)
    assert out.columns == odd.columns and out.count() == len(texts)
    assert line_dedup.dedup_lines(empty).count() == 0
    mixed = [(i, "\n".join(["ÄB x", "Foo", "", "bar", "foo ", f"own {i}"][i % 3 :])) for i in range(40)]
    docs = spark.createDataFrame(mixed, "doc_id long, text string")
    got = line_dedup.dedup_lines(docs).select("row.doc_id", "n_lines", "n_dropped", F.sha2("line_text", 256).alias("h")).collect()
    assert Counter(map(tuple, got)) == Counter(plain_lines(mixed))


def test_very_many_alternate_lines(spark):
    """100,000 lines of which every other one goes; linear in the lines."""
    text = "\n".join("same" if k % 2 else f"own {k}" for k in range(100_000))
    rows = [(0, text)] + [(i, "same") for i in range(1, 12)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).where("row.doc_id = 0").select("n_dropped", "line_text").first()
    assert got.n_dropped == 50_000 and got.line_text == "\n".join(f"own {k}" for k in range(0, 100_000, 2))
