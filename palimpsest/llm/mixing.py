"""Mixing sources to target weights, with DataFrame functions only.

Each source's documents form one stream of words, which is packed into blocks of a fixed length. The mix is cut into output
shards. Shards draw their source counts from an urn that holds one ticket for every slot a source is due, so a shard's counts
are multinomial given that all shards together meet each source's target. A source's n-th slot goes through a pseudorandom
permutation of that source's block numbers (another one in each pass over the source) and joins the block of that number. The
last block of a source, which may be short, stays last in each pass: so passes that are not cut short hold each word once and the
targets are met to the word. A source whose target is below its size never yields that block.

Rules for odd rows: a null or empty text has no words and is never taken; a null source is a source of its own, last in
order; rows that repeat an id (or are wholly equal) are separate documents; an empty table gives an empty mix; further
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE_CHARS, WORD, table, text_of, written

#: Words in a block, and slots in an output shard.
BLOCK = 256
SHARD = 1024
#: Weights of the sources in order, repeating; how much of all words the mix holds; how often a source may be used.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_PASSES = 2
#: Hexadecimal digits that name the part of a source's documents: 4096 parts, so that a source with most of the rows is no task.
PART_DIGITS = 3
#: Slots that one row of the slot table unfolds to.
RUN = 4096
#: Rounds of the permutation, and the prime that its round functions work in.
ROUNDS = 12
PRIME = 2147483647


def permuted(index: Column, n: Column, key: Column) -> Column:
    """A pseudorandom bijection of 0..n-1: swap-or-not rounds, each a reflection that half of the pairs take part in. Pivots have
    62 bits before they are reduced, so they spread over all of n."""

    key = key.cast("long")

    prime = F.lit(PRIME)

    def let(value: Column, body: Callable[[Column], Column]) -> Column:
        """body of a value that is computed once."""
        return F.get(F.transform(F.array(value), body), F.lit(0))

    def chosen(x: Column, high: Column, low: Column, other: Column) -> Column:
        larger = F.greatest(x, other)
        y = F.pmod(larger + F.pmod(F.floor(larger / PRIME) * 48271, prime), prime)
        coin = let(y, lambda y: F.pmod(F.pmod(F.pmod(y * y, prime) * F.pmod(low + 12345, prime), prime) + y * 69621 % PRIME + high, prime))
        return F.when(F.pmod(F.floor(coin / 1024), F.lit(2)) == 1, other).otherwise(x)

    def turn(x: Column, r: Column) -> Column:
        t = F.pmod(F.pmod(key + r * 7919, prime) * 48271 + 11 * r, prime)
        high = let(t, lambda t: F.pmod(F.pmod(t * t, prime) * F.pmod(t + r * 977, prime) + t, prime))
        low = lambda h: F.pmod(F.pmod(h * h, prime) * 16807 + 3 * r + 1, prime)
        other = lambda h, w: F.pmod(F.pmod(h * (PRIME + 1) + w, n) - x, n)
        return let(high, lambda h: let(low(h), lambda w: let(other(h, w), lambda o: chosen(x, h, w, o))))

    return F.when(n > 1, F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), index.cast("long"), lambda x, r: turn(x, r).cast("long"))).otherwise(F.lit(0).cast("long"))


def rank_key(id_column: str = "doc_id") -> Column:
    """A digest of a row's id and text, which orders the documents of a source."""
    return F.md5(F.concat_ws("|", F.coalesce(F.col(id_column).cast("string"), F.lit("")), F.md5(text_of())))


def sized(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """id, source, size, and where the row stands: the part of its source and its rank key in there."""
    key = rank_key(id_column)
    return docs.select(
        F.col(id_column).alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size"),
        key.alias("rank_key"),
        F.conv(F.substring(key, 1, PART_DIGITS), 16, 10).cast("int").alias("part"),
    )


def targets(parts: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_PASSES) -> DataFrame:
    """A row for each source: its size, weight, number and target. parts: (source, part, words).

    Shares that stop at their cap are filled in the order in which sources reach it: the level is the first at which what is
    left, dealt by weight, puts no later source above its cap (levels only sink after it, so it is the largest of those). One
    row for each source goes through one task.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by_source = parts.groupBy("source").agg(F.sum("words").alias("source_size"))
    n = F.row_number().over(order) - 1
    numbered = by_source.select("source", "source_size", n.cast("long").alias("number"), F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (n % len(weights) + 1).cast("int")).alias("weight"))
    capped = numbered.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("fill", F.col("cap") / F.col("weight"))
    before = Window.orderBy("fill", "number").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    levels = capped.withColumns({
        "left_words": F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "left_weight": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    }).withColumn("level", F.col("left_words") / F.col("left_weight"))
    level = F.max(F.when(F.col("level") <= F.col("fill"), F.col("level"))).over(everything)
    filled = levels.withColumn("target", F.least(F.col("cap"), F.coalesce(level, F.col("fill")) * F.col("weight")))
    return filled.select("source", "source_size", "weight", "number", "target", F.least(F.floor(F.col("target") + 0.5), F.floor("cap")).cast("long").alias("due"))


def mix_plan(docs: DataFrame, id_column: str = "doc_id", block: int = BLOCK, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """(documents with their place in their source's stream, slots of the mix).

    Documents: doc_id, source, size, source_size, target, number, at (words of the source before the document).
    Slots: number, pass, block, words, shard, position.
    """
    rows = written(sized(docs, id_column), "mix-sizes")
    parts = rows.groupBy("source", "part").agg(F.sum("size").alias("words"))
    sources = targets(parts)
    sources = written(sources, "mix-sources")
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.withColumn("part_at", F.coalesce(F.sum("words").over(before), F.lit(0)))
    starts = starts.join(sources, starts["source"].eqNullSafe(sources["source"])).select(starts["source"], "part", "part_at", "source_size", "target", "number")
    inside = Window.partitionBy("source", "part").orderBy("rank_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("in_part", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    same = placed["source"].eqNullSafe(starts["source"]) & (placed["part"] == starts["part"])
    placed = placed.join(starts, same).select(placed["doc_id"], placed["source"], "size", "rank_key", "source_size", "target", "number", (F.col("part_at") + F.col("in_part")).alias("at"))

    # Slots: every source's tickets, in runs that unfold in parallel.
    upto = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    counted = sources.where("due > 0").select(
        "number", "source_size", "due",
        F.expr("due div source_size").alias("passes"),
        F.ceil(F.col("source_size") / F.lit(block)).cast("long").alias("blocks"),
    ).withColumn("slots", F.col("passes") * F.col("blocks") + F.ceil((F.col("due") - F.col("passes") * F.col("source_size")) / F.lit(block)).cast("long"))
    counted = counted.withColumns({"ticket": F.coalesce(F.sum("slots").over(upto), F.lit(0)), "tickets": F.sum("slots").over(Window.partitionBy())})
    runs = counted.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / RUN))))
    # Few rows that unfold to many: a fixed number of partitions, which is not merged by the rows' size before they unfold.
    runs = runs.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "number", "run")
    slot = runs.withColumn("slot", F.explode(F.sequence(F.col("run") * RUN, F.least(F.col("slots"), (F.col("run") + 1) * RUN) - 1)))
    drawn = permuted(F.col("ticket") + F.col("slot"), F.col("tickets"), F.lit(1))
    slot = slot.select(
        "number", "blocks", "source_size", "due",
        F.floor(F.col("slot") / F.col("blocks")).alias("pass"), (F.col("slot") % F.col("blocks")).alias("rank"), drawn.alias("drawn"),
    )
    # A pass's last block is the short one that ends the source; the others are permuted.
    number = F.when(F.col("rank") == F.col("blocks") - 1, F.col("rank")).otherwise(permuted(F.col("rank"), F.col("blocks") - 1, F.col("number") * 131 + F.col("pass") * 17 + 2))
    words = F.least(F.lit(block), F.col("source_size") - F.col("rank") * block, F.col("due") - F.col("pass") * F.col("source_size") - F.col("rank") * block)
    slots = slot.select(
        "number", F.col("pass").cast("long").alias("pass"), number.cast("long").alias("block"), words.cast("long").alias("words"),
        F.floor(F.col("drawn") / shard).cast("long").alias("shard"), (F.col("drawn") % shard).cast("long").alias("position"),
    )
    return placed, slots


def mix(docs: DataFrame, id_column: str = "doc_id", block: int = BLOCK, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """(documents with their place, pieces of the mix). A piece is a run of one document's words in one slot of one shard:
    number, source, at, size, doc_id, rank_key, shard, position, offset (in the slot), pass, first (word of the document, from 0), words."""
    placed, slots = mix_plan(docs, id_column, block, shard)
    last = F.floor((F.col("at") + F.col("size") - 1) / block)
    cut = placed.where("size > 0").select("number", "source", "doc_id", "rank_key", "at", "size", F.explode(F.sequence(F.floor(F.col("at") / block), last)).alias("block"))
    # The planner knows the slots' size only before they unfold; a merge join keeps it from broadcasting them.
    joined = cut.join(slots.hint("merge"), ["number", "block"])
    begin = F.greatest(F.col("at"), F.col("block") * block)
    end = F.least(F.col("at") + F.col("size"), F.col("block") * block + F.col("words"))
    pieces = joined.select(
        "number", "source", "at", "size", "doc_id", "rank_key", "shard", "position", (begin - F.col("block") * block).alias("offset"), "pass",
        (begin - F.col("at")).alias("first"), (end - begin).alias("words"),
    ).where("words > 0")
    return placed, pieces


def taken_words(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of docs."""
    placed, pieces = mix(docs, id_column)
    used = pieces.groupBy("number", "at").agg(F.sum("words").alias("taken"))
    full = placed.join(used.withColumn("has", F.lit(True)), (placed["number"] == used["number"]) & (placed["at"] == used["at"]) & (placed["size"] > 0), "left")
    return full.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The mix as documents: a row of docs for each pass that takes any of its words, with the text cut to the words taken.

    A document that a pass takes whole keeps its text as it is; otherwise the taken words follow one another with the white
    space that stood behind each. n_chars, where there is such a column, is the new text's length.
    """
    _, pieces = mix(docs, id_column)
    runs = pieces.groupBy("source", "rank_key", "at", "size", "pass").agg(F.sum("words").alias("taken"), F.sort_array(F.collect_list(F.struct("first", "words"))).alias("runs"))
    return _cut(docs, runs, id_column)


def _cut(docs: DataFrame, runs: DataFrame, id_column: str) -> DataFrame:
    """Joins the runs to the texts by source and rank key (id and text). Only rows that agree in all of these share their runs,
    one to one: they are numbered among themselves, runs by place."""
    key = ["mix_source", "mix_key", "mix_nth"]
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("source").cast("string").alias("mix_source"), rank_key(id_column).alias("mix_key"))
    row = row.where(text_of("row.text").rlike(WORD)).withColumn("mix_nth", F.row_number().over(Window.partitionBy("mix_source", "mix_key").orderBy(F.xxhash64("row"))))
    place = Window.partitionBy("source", "rank_key").orderBy("at")
    wanted = runs.withColumn("nth", F.dense_rank().over(place)).select(F.col("source").alias("mix_source"), F.col("rank_key").alias("mix_key"), F.col("nth").alias("mix_nth"), F.col("size").alias("mix_size"), "taken", "runs")
    matched = row.join(wanted, [row[k].eqNullSafe(wanted[k]) for k in key]).select("row", "taken", "runs", "mix_size")
    whole = F.col("taken") == F.col("mix_size")
    words = matched.withColumn("words", F.when(~whole, F.regexp_extract_all(F.col("row.text"), F.lit(WORD + "[\\x20\\x09-\\x0D]*"), F.lit(0))))
    kept = F.flatten(F.transform("runs", lambda r: F.slice(F.col("words"), (r["first"] + 1).cast("int"), r["words"].cast("int"))))
    text = F.when(whole, F.col("row.text")).otherwise(F.rtrim(F.array_join(kept, ""), F.lit(SPACE_CHARS)))
    cut = words.select("row", text.alias("mix_text"))
    new = {"text": F.col("mix_text"), "n_chars": F.length("mix_text").cast("long")}
    return cut.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_words(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {"op1_mixing": op1_mixing}


def _permuted_sql(index: str, n: str, key: str) -> str:
    """permuted() in DuckDB: the rounds as a fold over their numbers."""
    t = f"((((({key}) + r * 7919) % {PRIME}) * 48271 + 11 * r) % {PRIME})"
    high = f"((({t} * {t} % {PRIME}) * (({t} + r * 977) % {PRIME}) + {t}) % {PRIME})"
    low = f"((({high} * {high} % {PRIME}) * 16807 + 3 * r + 1) % {PRIME})"
    other = f"(((({high} * {PRIME + 1} + {low}) % ({n}) - x) % ({n}) + ({n})) % ({n}))"
    larger = f"greatest(x, {other})"
    y = f"(({larger} + (({larger} // {PRIME}) * 48271) % {PRIME}) % {PRIME})"
    coin = f"((((({y} * {y}) % {PRIME}) * (({low} + 12345) % {PRIME})) % {PRIME} + ({y} * 69621) % {PRIME} + {high}) % {PRIME})"
    return f"CASE WHEN ({n}) > 1 THEN list_reduce(range(1, {ROUNDS + 1}), lambda x, r: CASE WHEN ({coin} // 1024) % 2 = 1 THEN {other} ELSE x END, ({index})::BIGINT) ELSE 0 END"


ORACLE = rf"""
WITH docs AS (
  SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))) AS rk,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
src AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number FROM (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source)),
w AS (SELECT *, [3.0, 1.0, 2.0][number % 3 + 1]::DOUBLE AS weight, source_size * {MOST_PASSES}.0::DOUBLE AS cap FROM src),
lv AS (
  SELECT *, cap / weight AS fill, (sum(source_size) OVER () * {SHARE}::DOUBLE - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM w WINDOW b AS (ORDER BY cap / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, least(cap, coalesce(max(CASE WHEN level <= fill THEN level END) OVER (), fill) * weight) AS target FROM lv),
s AS (SELECT *, least(floor(target + 0.5), floor(cap))::BIGINT AS due FROM t),
c AS (SELECT number, source_size, due, due // source_size AS passes, (source_size + {BLOCK - 1}) // {BLOCK} AS blocks FROM s WHERE due > 0),
k AS (SELECT *, passes * blocks + (due - passes * source_size + {BLOCK - 1}) // {BLOCK} AS slots FROM c),
sl AS (SELECT *, i // blocks AS pass, i % blocks AS rank FROM (SELECT *, unnest(range(0, slots)) AS i FROM k)),
used AS (
  SELECT number, CASE WHEN rank = blocks - 1 THEN rank ELSE {_permuted_sql("rank", "blocks - 1", "number * 131 + pass * 17 + 2")} END AS block,
         least({BLOCK}, source_size - rank * {BLOCK}, due - pass * source_size - rank * {BLOCK}) AS words FROM sl),
d AS (
  SELECT docs.*, s.source_size, s.target, s.number,
         coalesce(sum(size) OVER (PARTITION BY docs.source ORDER BY rk, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos
  FROM docs JOIN s ON docs.source IS NOT DISTINCT FROM s.source),
pieces AS (SELECT number, pos, size, unnest(range(pos // {BLOCK}, (pos + size - 1) // {BLOCK} + 1)) AS block FROM d WHERE size > 0),
got AS (
  SELECT p.number, p.pos, sum(greatest(0, least(p.pos + p.size, p.block * {BLOCK} + u.words) - greatest(p.pos, p.block * {BLOCK}))) AS taken
  FROM pieces p JOIN used u USING (number, block) GROUP BY 1, 2)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken
FROM d LEFT JOIN got ON d.number = got.number AND d.pos = got.pos AND d.size > 0
"""


def oracle_sql() -> dict:
    return {"op1_mixing": ORACLE}
