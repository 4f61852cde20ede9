"""Filter interaction audit: what each of several filters removes in every order in which they may be applied.

A document's failures are a bit mask. Documents are counted by part and mask; those cells are unpivoted against the steps of all
orders. A running bit-or over an order's earlier steps tells which documents an earlier filter has removed; conditional sums give
a step's counts, and a window over all rows of a filter in a part totals what it removes (the sum of which over all orders is the
filter's Shapley share times the number of orders).

The steps' running masks depend on the mask and the order only, so they are computed once for the at most 2^5 masks that occur
(19,200 rows at most), whatever the number of parts. A part costs 600 rows of the result and at most 32 cells.

A document is a copy if a smaller id has the same text. For this the rows are first reduced by (text digest, part, mask), with
the least id and what stands at it, so a text that a third of all rows share is a few rows for each task before it is shuffled.

Rules for odd rows: a null text is empty; a null source is the part named by the empty string; null ids are the largest, so a row
without an id is a copy if any row with an id has its text; rows that share the smallest id of a text are no copies; of several
labels of an id one that says 1 is enough; a document without a label, or without an id, is neither good nor toxic; an empty table gives an empty result; further columns are
ignored, whatever their names.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE_CHARS, table, text_of

#: The filters; the failure of the i-th is bit i of a mask.
FILTERS = "ABCDE"
#: A: fewer words. B: distinct words in percent of all. C: capital letters in percent of the characters. D: any of these.
FEWEST_WORDS = 50
LEAST_DISTINCT = 65
MOST_CAPITALS = 5
SYMBOLS = "[#$%&*|]"
#: The id of rows that have none.
NO_ID = 2**63 - 1


def text_mask(text: Column) -> Column:
    """The bits of the filters that look at the text alone."""
    words = F.filter(F.split(F.translate(text, SPACE_CHARS, " " * len(SPACE_CHARS)), " "), lambda w: w != "")
    return F.get(F.transform(F.array(words), lambda w: _text_bits(text, w)), F.lit(0))


def _text_bits(text: Column, words: Column) -> Column:
    n = F.size(words)
    fails = [
        n < FEWEST_WORDS,
        100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * n,
        100 * F.regexp_count(text, F.lit("[A-Z]")) > MOST_CAPITALS * F.length(text),
        text.rlike(SYMBOLS),
    ]
    bits = F.lit(0)
    for i, failed in enumerate(fails):
        bits = bits.bitwiseOR(F.when(failed, F.lit(1 << i)).otherwise(F.lit(0)))
    return bits


def cells(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """part, mask, docs, good, toxic: how many documents of a part fail exactly the filters of the mask."""
    rows = docs.select(
        F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.sha2(text_of(), 256).alias("digest"), text_mask(text_of()).alias("bits"),
    )
    # Equal ids with equal texts first become one row with a count.
    rows = rows.groupBy("id", "digest", "part", "bits").agg(F.count("*").alias("docs"))
    known = labels.where(F.col(id_column).isNotNull()).groupBy(F.col(id_column).cast("long").alias("id"))
    known = known.agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    # Rows without an id have no label, and must not meet in the join as one key.
    marked = rows.where(F.col("id") != NO_ID).join(known, "id", "left").unionByName(rows.where(F.col("id") == NO_ID).withColumns({"good": F.lit(None).cast("int"), "toxic": F.lit(None).cast("int")}))
    of = lambda c: F.col("docs") * F.coalesce(F.col(c), F.lit(0))
    marked = marked.select("id", "digest", "part", "bits", "docs", of("good").alias("good"), of("toxic").alias("toxic"))
    # Rows of an id, a text and a part are one row here, so what stands at the least id is one row for each part.
    sums = ("docs", "good", "toxic")
    texts = marked.groupBy("digest", "part", "bits").agg(F.min("id").alias("least"), F.min_by(F.struct(*sums), "id").alias("first"), *[F.sum(c).alias(c) for c in sums])
    least = F.min("least").over(Window.partitionBy("digest"))
    texts = texts.withColumn("original", F.col("least") == least)
    kept = {c: F.when(F.col("original"), F.col(f"first.{c}")).otherwise(F.lit(0)) for c in sums}
    copy_bit = 1 << FILTERS.index("E")
    both = F.array(
        F.struct(F.col("bits").alias("mask"), *[kept[c].alias(c) for c in sums]),
        F.struct(F.col("bits").bitwiseOR(F.lit(copy_bit)).alias("mask"), *[(F.col(c) - kept[c]).alias(c) for c in sums]),
    )
    split = texts.select("part", F.explode(both).alias("c")).select("part", "c.mask", *[f"c.{c}" for c in sums])
    return split.where("docs > 0").groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in sums])


def steps(spark: SparkSession, masks: DataFrame) -> DataFrame:
    """mask, filter_order, step, filter, fails, earlier: every mask's cells unpivoted against the steps of every order."""
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    long = masks.select("mask", F.explode(orders).alias("filter_order")).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    long = long.withColumn("filter", F.substring("filter_order", F.col("step"), 1))
    bit = F.expr(f"shiftleft(1, cast(locate(filter, '{FILTERS}') - 1 as int))")
    long = long.withColumn("hit", F.col("mask").bitwiseAND(bit))
    before = Window.partitionBy("mask", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.bit_or("hit").over(before), F.lit(0))
    return long.select("mask", "filter_order", "step", "filter", (F.col("hit") != 0).alias("fails"), (earlier != 0).alias("earlier"), (F.col("mask") == F.col("hit")).alias("alone"))


def audit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """part, filter_order, step, filter and the counts of every step of every order in every part."""
    counted = cells(docs, labels, id_column)
    every_mask = docs.sparkSession.range(1 << len(FILTERS)).select(F.col("id").cast("int").alias("mask"))
    # 2^5 masks times 600 steps: 19,200 rows, whatever the data.
    met = counted.join(F.broadcast(steps(docs.sparkSession, every_mask)), "mask")
    when = lambda test, c="docs": F.sum(F.when(test, F.col(c)).otherwise(F.lit(0)))
    gone = F.col("fails") & ~F.col("earlier")
    sums = met.groupBy("part", "filter_order", "step", "filter").agg(
        when(~F.col("fails") & ~F.col("earlier")).alias("kept"),
        when(gone).alias("removed"),
        when(F.col("fails") & F.col("earlier")).alias("redundant"),
        when(F.col("fails") & F.col("alone")).alias("unique_fails"),
        when(gone, "good").alias("good_lost"),
        when(gone, "toxic").alias("toxic_lost"),
    )
    return sums.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter")))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("filter")


def queries() -> dict:
    return {"op11_filter_audit": op11_filter_audit}


_BITS = {
    "A": f"len(words) < {FEWEST_WORDS}",
    "B": f"100 * len(list_distinct(words)) < {LEAST_DISTINCT} * len(words)",
    "C": f"100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > {MOST_CAPITALS} * length(t)",
    "D": f"regexp_matches(t, '{SYMBOLS}')",
    "E": "coalesce(doc_id, 9223372036854775807) > min(coalesce(doc_id, 9223372036854775807)) OVER (PARTITION BY t)",
}
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, {", ".join(f"({test})::INT AS f{name}" for name, test in _BITS.items())}, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM d LEFT JOIN l USING (doc_id)),
c AS (SELECT part, {" || ".join(f"CASE WHEN f{name} = 1 THEN '{name}' ELSE '' END" for name in FILTERS)} AS mask, count(*) AS docs, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
f(x) AS (VALUES {", ".join(f"('{name}')" for name in FILTERS)}),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (
  SELECT part, filter_order, step, filter_order[step] AS filter, docs, good, toxic, mask, contains(mask, filter_order[step]) AS fails,
         len(list_filter(range(1, step), lambda i: contains(mask, filter_order[i]))) > 0 AS earlier
  FROM c, o, (SELECT unnest(range(1, 6))::INT AS step)),
g AS (
  SELECT part, filter_order, step, filter,
         sum(CASE WHEN NOT fails AND NOT earlier THEN docs ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN fails AND NOT earlier THEN docs ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN fails AND earlier THEN docs ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN mask = filter THEN docs ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN fails AND NOT earlier THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN fails AND NOT earlier THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM g
"""


def oracle_sql() -> dict:
    return {"op11_filter_audit": ORACLE}
