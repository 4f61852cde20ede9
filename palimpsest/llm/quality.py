"""Quality rules with risk-controlled thresholds, with DataFrame functions only.

Every document gets counts and a few scores (more is worse). A rule rejects a document whose score lies above the rule's cutoff
in the document's stratum, its language. Cutoffs come from the labelled documents. STEPS is a fixed sequence in which one rule
after another gets a stricter cutoff. For each step, the labelled good documents of the stratum that all rules together would
then reject are a binomial count, and the step is admissible if the exact binomial tail P(Bin(n, alpha) <= k) is at most
delta / strata. Testing goes from the most lenient step to the strictest and stops at the first that fails (fixed sequence), so
a stratum is one test, whatever the number of rules, and delta is divided by the number of strata (Bonferroni): with probability
1 - DELTA, in all strata at once, the rules falsely reject at most ALPHA of the good documents that pass the base checks. A
stratum with too few labels for that (fewer than log(DELTA / strata) / log(1 - ALPHA): 42 for four strata) has no cutoffs, is
listed by ``cutoffs`` with its number of labels, and rejects nothing beyond the base checks.

Rules for odd rows: a null or empty text has no words and fails the base checks; a null language is a stratum; labels whose
document is missing, null labels and ids with labels that disagree are not used; rows that repeat an id are judged each by
their own text; an empty table gives an empty result; further columns are ignored or passed through, whatever their names.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, row_key, table, text_of, written

#: Base checks: fewer words than this, or more than this percentage of words in repeated windows.
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Words in a window.
WINDOW = 5
#: Allowed share of good documents that the rules reject, and the chance that it is exceeded anywhere.
ALPHA = 0.10
DELTA = 0.05
#: Each rule's cutoffs from the most lenient to the strictest. Fixed values.
CUTOFFS = {
    "symbols": (2.0, 1.0, 0.5, 0.2, 0.1, 0.05),
    "capitals": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4),
    "exclamations": (1.0, 0.5, 0.2, 0.1, 0.05),
    "duplicate_lines": (0.8, 0.6, 0.4, 0.3),
    "repeats": (0.2, 0.15, 0.1),
}



def _steps(*groups: tuple[str, ...]) -> list[tuple[str, float]]:
    """The rules of a group take turns, each with its next cutoff, before those of the next group begin."""
    return [(rule, CUTOFFS[rule][i]) for rules in groups for i in range(max(len(CUTOFFS[r]) for r in rules)) for rule in rules if i < len(CUTOFFS[rule])]


#: (rule, its cutoff from there on): signs first, then repetition.
STEPS = _steps(("symbols", "capitals", "exclamations"), ("duplicate_lines", "repeats"))


def cutoffs_at(step: int) -> dict[str, float]:
    """The cutoffs of all rules that have one after a step."""
    return dict(STEPS[: step + 1])


def features(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """id, row_key, lang and the counts of each row of docs."""
    base = docs.select(F.col(id_column).alias("id"), row_key(id_column).alias("row_key"), F.col("lang").cast("string").alias("lang"), text_of().alias("t"))
    lines = F.filter(F.split("t", "\n", -1), lambda x: x.rlike(WORD))
    split = base.withColumns({"words": F.regexp_extract_all("t", F.lit(WORD), F.lit(0)), "lines": lines})
    n = F.size("words")
    hashed = split.select(
        "id", "row_key", "lang", n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        F.regexp_count("t", F.lit("[A-Z]")).cast("long").alias("n_capitals"),
        F.regexp_count("t", F.lit("!")).cast("long").alias("n_exclamations"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    at = F.sequence(F.lit(0), F.col("n_words").cast("int") - WINDOW)
    window = F.transform(at, lambda i: F.xxhash64(*[F.get("hashes", i + k) for k in range(WINDOW)]))
    none = F.array().cast("array<long>")
    windowed = hashed.withColumn("windows", F.when(F.col("n_words") >= WINDOW, window).otherwise(none)).drop("hashes")
    # Only texts in which some window's hash stands twice are sorted.
    twice = F.size(F.array_distinct("windows")) < F.size("windows")
    pairs = F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("i"))))
    placed = windowed.withColumn("placed", F.when(twice, pairs)).drop("windows")
    near = lambda k, x: F.coalesce(F.get("placed", k)["h"] == x["h"], F.lit(False))
    repeated = F.filter("placed", lambda x, k: near(k - 1, x) | near(k + 1, x))
    starts = placed.withColumn("starts", F.array_sort(F.transform(repeated, lambda x: x["i"]))).drop("placed")
    return starts.withColumn("n_repeat_words", F.coalesce(covered("starts"), F.lit(0).cast("long"))).drop("starts")


def covered(starts: str) -> Column:
    """Words in the union of the windows that start at the given positions, in order."""
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))

    def add(s: Column, i: Column) -> Column:
        return F.struct((i + WINDOW).alias("end"), (s["n"] + i + WINDOW - F.greatest(s["end"], i)).alias("n"))

    return F.aggregate(starts, zero, add, lambda s: s["n"])


def scores() -> dict[str, Column]:
    """A rule's score; null where the text has nothing to score."""
    over = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    return {
        "symbols": over("n_symbols", "n_words"),
        "capitals": over("n_capitals", "word_chars"),
        "exclamations": over("n_exclamations", "n_words"),
        "duplicate_lines": over("n_dup_lines", "n_lines"),
        "repeats": over("n_repeat_words", "n_words"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k): terms by recurrence from (1 - p)^n, in logarithms. k stays below n * p for any tail of use."""
    start = F.struct((n * F.log(F.lit(1.0 - p))).alias("term"), F.exp(n * F.log(F.lit(1.0 - p))).alias("sum"))
    odds = F.log(F.lit(p / (1.0 - p)))

    def add(s: Column, j: Column) -> Column:
        term = s["term"] + F.log((n - j + 1) / j) + odds
        return F.struct(term.alias("term"), (s["sum"] + F.exp(term)).alias("sum"))

    tail = F.aggregate(F.sequence(F.lit(1).cast("long"), k), start, add, lambda s: s["sum"])
    return F.when(k >= n * p, F.lit(1.0)).when(k == 0, F.exp(n * F.log(F.lit(1.0 - p)))).otherwise(tail)


def cutoffs(counted: DataFrame, labels: DataFrame, id_column: str = "doc_id", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """stratum, n (its labelled good documents), and a cutoff for each rule (null: it rejects nothing). counted: features() of all documents."""
    agreed = labels.where(F.col("quality").isNotNull()).groupBy(F.col(id_column).alias("label_id")).agg(F.min("quality").alias("worst"), F.max("quality").alias("best"))
    good = agreed.where("worst = 1 AND best = 1").select("label_id")
    holdout = counted.join(good, counted["id"] == good["label_id"], "left_semi").where(~base_failed())
    score = scores()
    rejected = [F.count_if(reduce(or_, [F.coalesce(score[rule] > cut, F.lit(False)) for rule, cut in cutoffs_at(i).items()])).alias(f"k_{i}") for i in range(len(STEPS))]
    tried = holdout.groupBy(F.col("lang").alias("stratum")).agg(F.count(F.lit(1)).alias("n"), *rejected)
    tests = F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(i).alias("i"), F.lit(float(cut)).alias("cut"), F.col(f"k_{i}").alias("k")) for i, (rule, cut) in enumerate(STEPS)])
    rows = tried.withColumn("strata", F.count(F.lit(1)).over(Window.partitionBy())).select("stratum", "n", "strata", F.explode(tests).alias("test")).select("stratum", "n", "strata", "test.*")
    passed = rows.withColumn("passed", (binomial_tail(F.col("n"), F.col("k"), alpha) <= F.lit(delta) / F.col("strata")).cast("int"))
    so_far = Window.partitionBy("stratum").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    chosen = passed.withColumn("all_passed", F.min("passed").over(so_far))
    return chosen.groupBy("stratum", "n").agg(*[F.min(F.when((F.col("rule") == rule) & (F.col("all_passed") == 1), F.col("cut"))).alias(f"cut_{rule}") for rule in CUTOFFS])


def judged(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """id, row_key, counts, base_failed and kept for every row of docs.

    The counts (no texts) and the cutoffs (a row for each language) are written once; the second is joined by what its file's
    size allows.
    """
    counted = written(features(docs, id_column), "quality-counts")
    cut = written(cutoffs(counted, labels, id_column), "quality-cutoffs")
    met = counted.join(cut, counted["lang"].eqNullSafe(cut["stratum"]), "left")
    score = scores()
    rejected = reduce(or_, [F.coalesce(score[rule] > F.col(f"cut_{rule}"), F.lit(False)) for rule in CUTOFFS])
    return met.select("id", "row_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), (~(base_failed() | rejected)).alias("kept"))


def kept_documents(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The rows of docs that the rules keep."""
    good = judged(docs, labels, id_column).where("kept").select("id", "row_key").distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_column).alias("r_id"), row_key(id_column).alias("r_key"))
    kept = rows.join(good, (rows["r_key"] == good["row_key"]) & rows["r_id"].eqNullSafe(good["id"]), "left_semi")
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels"))
    return out.withColumnRenamed("id", "doc_id").drop("row_key")


def queries() -> dict:
    return {"op6_quality": op6_quality}


def _oracle() -> str:
    columns = {"symbols": "n_symbols / n_words", "capitals": "n_capitals / word_chars", "exclamations": "n_exclamations / n_words", "duplicate_lines": "n_dup_lines / n_lines", "repeats": "n_repeat_words / n_words"}
    score = {k: f"({a}::DOUBLE / nullif({b}, 0)::DOUBLE)" for k, v in columns.items() for a, b in [v.split(" / ")]}
    none = "'Infinity'::DOUBLE"
    tests = ", ".join(f"('{rule}', {i}, {cut}::DOUBLE, " + ", ".join(f"{cutoffs_at(i)[r]}::DOUBLE" if r in cutoffs_at(i) else none for r in CUTOFFS) + ")" for i, (rule, cut) in enumerate(STEPS))
    names = ", ".join(f"at_{r}" for r in CUTOFFS)
    at_once = " OR ".join(f"coalesce({score[k]} > at_{k}, false)" for k in CUTOFFS)
    p = ALPHA
    above = " OR ".join(f"coalesce({score[k]} > cut_{k}, false)" for k in CUTOFFS)
    picks = ", ".join(f"min(cut) FILTER (WHERE rule = '{k}') AS cut_{k}" for k in CUTOFFS)
    return rf"""
WITH w AS (
  SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS lines FROM documents),
g AS (SELECT doc_id, t, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS win FROM (SELECT doc_id, t, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w WHERE len(words) >= {WINDOW})),
r AS (SELECT doc_id, t, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, t, win) AS c FROM g) WHERE c > 1),
v AS (SELECT doc_id, t, sum({WINDOW} - greatest(0, coalesce(prev + {WINDOW} - i, 0))) AS n FROM (SELECT *, lag(i) OVER (PARTITION BY doc_id, t ORDER BY i) AS prev FROM r) GROUP BY 1, 2),
f AS (
  SELECT w.doc_id, lang, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(w.t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines)::BIGINT AS n_lines,
         len(regexp_extract_all(w.t, '[A-Z]'))::BIGINT AS n_capitals, len(regexp_extract_all(w.t, '!'))::BIGINT AS n_exclamations, coalesce(v.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN v ON w.doc_id = v.doc_id AND w.t = v.t),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM f),
good AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1 AND max(quality) = 1),
h AS (SELECT * FROM b WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM good)),
k AS (SELECT lang AS stratum, rule, i, cut, count(*) AS n, count(*) FILTER (WHERE {at_once}) AS k FROM h, (VALUES {tests}) AS t(rule, i, cut, {names}) GROUP BY lang, rule, i, cut),
s AS (SELECT *, (SELECT count(DISTINCT coalesce(lang, chr(0))) FROM h) AS strata,
        CASE WHEN k >= n * {p!r} THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({p!r}) + (n - j) * ln(1 - {p!r})))) END AS tail FROM k),
c AS (SELECT stratum, rule, cut FROM (SELECT *, min((tail <= {DELTA} / strata)::INT) OVER (PARTITION BY stratum ORDER BY i) AS ok FROM s) WHERE ok = 1),
p AS (SELECT stratum, {picks} FROM c GROUP BY stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR {above}) AS kept
FROM b LEFT JOIN p ON b.lang IS NOT DISTINCT FROM p.stratum
"""


def oracle_sql() -> dict:
    return {"op6_quality": _oracle()}
