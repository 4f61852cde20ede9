"""Line dedup, with DataFrame functions only: lines whose key stands in many documents leave every document.

Lines become rows of (128 bits of the key, document, position) without their text. These are range-partitioned by hash and by
a salt that the document sets, and sorted within by document and position, so a very frequent line spreads over as many tasks
as its rows fill. A stream over the sorted rows marks a document's first occurrence of a line; the marks add up to the number
of documents. Lines at or above the limit come back as one compressed bitmap for each document: lengths of runs of kept and
dropped lines in turn, kept first. Texts meet their bitmap in one join.

Rules for odd rows: a null or empty text is one empty line; rows with the same id are one document when documents are counted,
and null is such an id; wholly equal rows share a bitmap and stay separate rows; an empty table gives an empty result; further
columns pass through untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE_CHARS, row_key, table, text_of, written

#: A key of at least so many code points, in at least so many documents, is dropped.
MIN_KEY = 1
MIN_DOCS = 10
#: Salts that a line's rows can spread over.
SALTS = 1024

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """White space goes from both ends, A-Z become lower case. Lines of ASCII take the faster built-in."""
    bare = F.trim(line, F.lit(SPACE_CHARS))
    return F.when(F.length(bare) == F.octet_length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def line_rows(docs: DataFrame, id_column: str = "doc_id", min_key: int = MIN_KEY) -> DataFrame:
    """h1, h2 (hash of the key), salt, id, key of the row, pos; only lines whose key is long enough."""
    lines = docs.select(F.col(id_column).alias("id"), row_key(id_column).alias("row_key"), F.posexplode(F.split(text_of(), "\n", -1)).alias("pos", "line"))
    keyed = lines.select("id", "row_key", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_key)
    return keyed.select(
        F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"),
        F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"), "id", "row_key", "pos",
    )


def keep_bitmaps(docs: DataFrame, id_column: str = "doc_id", min_docs: int = MIN_DOCS, min_key: int = MIN_KEY) -> DataFrame:
    """id, row_key, n_dropped, bitmap (lengths of runs, kept first) of the rows that lose lines."""
    rows = written(line_rows(docs, id_column, min_key), "line-hashes")
    hashed = ["h1", "h2", "salt"]
    ranged = rows.repartitionByRange(*hashed)
    stream = Window.partitionBy(*hashed).orderBy("id", "row_key", "pos")
    first = F.row_number().over(stream) == 1
    first = first | ~F.lag("id").over(stream).eqNullSafe(F.col("id"))
    counts = ranged.withColumn("first", first.cast("long")).groupBy(*hashed).agg(F.sum("first").alias("n"))
    # A key has at most SALTS rows here.
    total = F.sum("n").over(Window.partitionBy("h1", "h2"))
    frequent = counts.withColumn("documents", total).where(F.col("documents") >= min_docs).select(*hashed)
    dropped = rows.join(frequent, hashed, "left_semi")
    gone = dropped.groupBy("id", "row_key").agg(F.array_sort(F.array_distinct(F.collect_list("pos"))).alias("gone"))
    return gone.select("id", "row_key", F.size("gone").cast("long").alias("n_dropped"), run_lengths(F.col("gone")).alias("bitmap"))


def run_lengths(gone: Column) -> Column:
    """Sorted positions of dropped lines as lengths of runs: kept, dropped, kept, dropped ... (what follows is kept)."""
    none = F.array(F.lit(-2))
    back = F.arrays_zip(gone.alias("p"), F.concat(none, F.slice(gone, F.lit(1), F.size(gone) - 1)).alias("q"))
    ahead = F.arrays_zip(gone.alias("p"), F.concat(F.slice(gone, F.lit(2), F.size(gone)), none).alias("q"))
    begin = F.transform(F.filter(back, lambda x: x["q"] + 1 != x["p"]), lambda x: x["p"])
    end = F.transform(F.filter(ahead, lambda x: x["p"] + 1 != x["q"]), lambda x: x["p"] + 1)
    runs = F.arrays_zip(begin.alias("b"), end.alias("e"), F.concat(F.array(F.lit(0)), F.slice(end, F.lit(1), F.size(end) - 1)).alias("last"))
    return F.flatten(F.transform(runs, lambda r: F.array(r["b"] - r["last"], r["e"] - r["b"])))


def kept_text(text: Column, bitmap: Column) -> Column:
    """The lines that the bitmap keeps, joined again."""
    dropped = F.flatten(F.transform(bitmap, lambda n, i: F.array_repeat(i % 2 == 1, n)))
    lines = F.arrays_zip(F.split(text, "\n", -1).alias("line"), dropped.alias("gone"))
    kept = F.transform(F.filter(lines, lambda x: ~F.coalesce(x["gone"], F.lit(False))), lambda x: x["line"])
    return F.when(bitmap.isNull(), text).otherwise(F.array_join(kept, "\n"))


def dedup_lines(docs: DataFrame, id_column: str = "doc_id", min_docs: int = MIN_DOCS, min_key: int = MIN_KEY) -> DataFrame:
    """Every row of docs as ``row``, with line_text (what stays), n_lines and n_dropped."""
    bitmaps = keep_bitmaps(docs, id_column, min_docs, min_key)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_column).alias("r_id"), row_key(id_column).alias("r_key"))
    joined = rows.join(bitmaps, (rows["r_key"] == bitmaps["row_key"]) & rows["r_id"].eqNullSafe(bitmaps["id"]), "left")
    text = F.coalesce(F.col("row.text"), F.lit(""))
    return joined.select(
        "row", kept_text(text, F.col("bitmap")).alias("line_text"),
        F.size(F.split(text, "\n", -1)).cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
    )


def deduplicated_documents(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """docs without the frequent lines. n_chars, where there is such a column, is the new text's length."""
    out = dedup_lines(docs, id_column)
    changed = F.when(F.col("n_dropped") > 0, F.col("line_text")).otherwise(F.col("row.text"))
    new = {"text": changed}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_dropped") > 0, F.length("line_text").cast("long")).otherwise(F.col("row.n_chars"))
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.col("line_text"), 256).alias("kept_sha256"))


def queries() -> dict:
    return {"op7_line_dedup": op7_line_dedup}


ORACLE = r"""
WITH l AS (
  SELECT doc_id, t, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos
  FROM (SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)),
k AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE f.key IS NOT NULL)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f USING (key) GROUP BY doc_id, t
"""


def oracle_sql() -> dict:
    return {"op7_line_dedup": ORACLE}
