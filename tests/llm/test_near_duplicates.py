"""The near-duplicate stage against all pairs' Jaccard similarities of five-word shingles."""

import random

import corpus_pipeline
from palimpsest.llm import similar_texts, simhash

SHAPE = "doc_id long, text string"


def plain_kept(rows):
    sets = [{b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").lower().encode().split()) else set() for _, t in rows]
    group = list(range(len(rows)))
    for i, s in enumerate(sets):
        for j in range(i):
            if 5 * len(s & sets[j]) >= 4 * len(s | sets[j]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    return sorted({min(rows[k][0] for k in range(len(rows)) if group[k] == g) for g in group})


def edited(words, rng, n):
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"x{rng.randrange(9999)}"
    return " ".join(out)


def test_edited_copies_are_found(spark):
    rng = random.Random(4)
    rows = [(900, None), (901, " "), (902, "three short words"), (903, "Three  short WORDS")]
    passage = [f"p{k}" for k in range(60)]
    for g in range(40):
        words = [f"g{g}w{rng.randrange(5000)}" for _ in range(rng.choice((40, 100, 300)))]
        if g % 3 == 0:
            words[10:10] = passage
        for n in (0, 1, len(words) // 100 + 1, len(words) // 40, len(words) // 20):
            rows.append((len(rows), edited(words, rng, n)))
    group = [f"big{k}" for k in range(200)]
    rows += [(1000 + k, edited(group, rng, rng.choice((1, 2, 3, 4)))) for k in range(60)]
    rng.shuffle(rows)
    got = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, SHAPE).repartition(5), "").collect()}
    want = set(plain_kept(rows))
    # Links are true, so nothing goes that should stay; of the rows that should go a few in a hundred may be missed.
    assert want <= got
    assert len(got - want) <= 0.03 * (len(rows) - len(want))


def test_groups_larger_than_a_bucket_lose_no_candidate(spark, monkeypatch):
    monkeypatch.setattr(similar_texts, "FIRST", 1)
    monkeypatch.setattr(similar_texts, "HELD", 2)
    monkeypatch.setattr(similar_texts, "STREAMED", 3)
    test_edited_copies_are_found(spark)


def test_odd_rows(odd, empty, texts):
    kept = similar_texts.representatives(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.select("doc_id").where("doc_id IS NOT NULL").collect()) == [i for i in plain_kept([t for t in texts if t[0] is not None])]
    assert similar_texts.representatives(empty).count() == 0


def test_components_of_chains_and_stars(spark, monkeypatch):
    monkeypatch.setattr(simhash, "EDGES", 40)
    rng = random.Random(3)
    names = rng.sample(range(10**6), 700)
    links = list(zip(names[:200], names[1:200])) + [(names[300], x) for x in names[301:500]] + [(names[500 + k], names[500 + k // 2]) for k in range(1, 200)]
    rows = [(min(x), max(x)) for x in links]
    rng.shuffle(rows)
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(rows, "a long, b long")).collect()}
    want = {x: min(g) for g in (names[:200], names[300:500], names[500:]) for x in g}
    assert got == want
