"""Merkle dataset manifest: a digest for each row, a tree for each source, a tree over the sources, and a proof for every row.

Bottom-up build: rows become leaves (SHA-256 of their columns), leaves get a position in their source by range partitions, and
each level, a written table of runs of up to FAN siblings, yields the next one's nodes until a source has one node left, its
subroot. Subroots are the leaves of the tree over the sources. Top-down proof push: the levels are joined children to parents,
from the root down; a child prepends its siblings to the proof that its parent has inherited. A proof travels once for each run;
a row's proof is put together in the run that holds the row, so what is shuffled below the lowest inner level is one proof for
FAN rows.

A proof is a list of (left, right), from the row up to the root: the joined digests of the run's nodes before and after the node.
Folding it with a row's digest gives the root exactly if neither the row nor the proof was changed.

Positions don't need a window over a source: rows are range-partitioned by (source, id, leaf), sorted inside partitions and
numbered there; counts of the few (partition, source) pairs shift the numbers. So a source that holds most of the rows is spread
over partitions like any other.

Rules for odd rows: a null column counts as ``-``, an empty text as a value of no bytes; a null source is a source of its own,
first in order; rows without an id come first in their source and are never tampered with; rows that repeat an id are ordered by
their leaf, and wholly equal rows are separate leaves whose order makes no difference to the tree; a source with one row has
that row's leaf as its subroot; an empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

#: Siblings in a run.
FAN = 16
#: The columns of a leaf, in order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows whose id's CRC-32 this divides are tampered with.
TAMPERED = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PAIR = "array<struct<left:string,right:string>>"


def leaf_digest(columns: list[Column]) -> Column:
    """SHA-256 of the columns' values, each led by its length in bytes."""
    parts = []
    for c in columns:
        value = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def tampered_text(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(proof, leaf, lambda digest, p: F.sha2(F.concat(p["left"], digest, p["right"]), 256))


def proof_digest(proof: Column) -> Column:
    """SHA-256 of all siblings of a proof, from the row up, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda p: F.concat(p["left"], p["right"])), ""), 256)


def placed(nodes: DataFrame, tree: str, order: list[str], label: str) -> DataFrame:
    """nodes with ``pos``, the place in the tree's order from 0, and ``n``, the number of nodes of the tree.

    A range partition holds a stretch of the order, so a row's place is its number in its partition, less that of the tree's
    first row there, plus the rows of the tree in earlier partitions. There are at most as many (partition, tree) pairs as
    partitions and trees together.
    """
    keys = [F.col(tree).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order]]
    count = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = nodes.repartitionByRange(count, *keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    spread = written(spread, label).withColumns({"part": F.shiftright("at", 33), "row": F.col("at").bitwiseAND(F.lit((1 << 33) - 1))})
    pairs = spread.groupBy(F.col(tree).alias("of"), F.col("part").alias("in_part")).agg(F.min("row").alias("first_row"), F.count("*").alias("rows"))
    every = Window.partitionBy("of")
    before = every.orderBy("in_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = pairs.select("of", "in_part", (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first_row")).alias("shift"), F.sum("rows").over(every).alias("n"))
    met = spread.join(starts, spread[tree].eqNullSafe(starts["of"]) & (spread["part"] == starts["in_part"]))
    return met.select(*nodes.columns, (F.col("row") + F.col("shift")).alias("pos"), "n")


def _runs(nodes: DataFrame, *of_leaf: str) -> DataFrame:
    """Nodes of trees with more than one -> a row for each run of siblings: tree, run, n, kids in order."""
    kid = F.struct("pos", "digest", *of_leaf)
    grouped = nodes.where("n > 1").groupBy("tree", F.expr(f"pos div {FAN}").alias("run"), "n")
    return grouped.agg(F.array_sort(F.collect_list(kid)).alias("kids"))


def _parents(runs: DataFrame) -> DataFrame:
    digest = F.sha2(F.array_join(F.transform("kids", lambda k: k["digest"]), ""), 256)
    return runs.select("tree", F.col("run").alias("pos"), digest.alias("digest"), F.expr(f"(n + {FAN - 1}) div {FAN}").alias("n"))


def built(nodes: DataFrame, label: str, *of_leaf: str) -> tuple[list[DataFrame], DataFrame]:
    """(each level's runs from the leaves up, the trees' tops). nodes: tree, digest, pos, n and the leaves' own columns.

    Tops: tree, level, digest. A level is a FAN-th of the one below; the loop ends when no tree has more than one node.
    """
    levels: list[DataFrame] = []
    tops = nodes.where("n = 1").select("tree", F.lit(0).alias("level"), "digest")
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        levels.append(written(_runs(nodes, *(of_leaf if not levels else ())), f"{label}-level-{len(levels)}"))
        nodes = _parents(levels[-1])
        most = -(-most // FAN)
        tops = tops.unionByName(nodes.where("n = 1").select("tree", F.lit(len(levels)).alias("level"), "digest"))
    return levels, tops


def pushed(levels: list[DataFrame], tops: DataFrame, *of_leaf: str) -> DataFrame:
    """Every leaf that has siblings with its proof: tree, digest, proof, root, subroot and the leaves' own columns.

    tops: tree, level, proof, root, subroot: what the tree's top inherits.
    """
    def at_level(level: int) -> DataFrame:
        return tops.where(F.col("level") == level).select("tree", F.lit(0).cast("long").alias("pos"), "proof", "root", "subroot")

    nodes = None
    for level in reversed(range(len(levels))):
        parents = at_level(level + 1) if nodes is None else at_level(level + 1).unionByName(nodes.select("tree", "pos", "proof", "root", "subroot"))
        runs = levels[level]
        met = runs.join(parents, runs["tree"].eqNullSafe(parents["tree"]) & (runs["run"] == parents["pos"]))
        digests = F.transform("kids", lambda k: k["digest"])
        kids = met.select(runs["tree"], digests.alias("digests"), "proof", "root", "subroot", F.posexplode("kids").alias("i", "kid"))
        left, right = F.array_join(F.slice("digests", 1, F.col("i")), ""), F.array_join(F.slice("digests", F.col("i") + 2, FAN), "")
        proof = F.concat(F.array(F.struct(left.alias("left"), right.alias("right"))), F.col("proof"))
        own = of_leaf if level == 0 else ()
        nodes = kids.select("tree", F.col("kid.pos").alias("pos"), F.col("kid.digest").alias("digest"), proof.alias("proof"), "root", "subroot", *[F.col(f"kid.{c}").alias(c) for c in own])
    return nodes


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, source, leaf, tampered_leaf (null: the row was left alone), subroot, root, proof of every row."""
    hit = F.crc32(F.col("doc_id").cast("string")) % TAMPERED == 0
    other = leaf_digest([F.col(c) if c != "text" else tampered_text(F.col("text")) for c in COLUMNS])
    leaves = docs.select("doc_id", F.col("source").cast("string").alias("tree"), leaf_digest([F.col(c) for c in COLUMNS]).alias("digest"), F.when(hit, other).alias("tampered"))
    # Range partitions sample their input: digests are written before, so that texts are read once.
    nodes = placed(written(leaves, "merkle-leaves"), "tree", ["doc_id", "digest"], "merkle-order")
    own = ("doc_id", "tampered")
    levels, subroots = built(nodes, "merkle", *own)
    subroots = written(subroots, "merkle-subroots")

    # The tree over the sources: one tree whose leaves are the subroots.
    sources = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("source"), "level", "digest")
    upper, root = built(placed(sources, "tree", ["source"], "merkle-sources"), "merkle-upper", "source", "level")
    root = written(root.select("tree", "level", F.array().cast(_PAIR).alias("proof"), F.col("digest").alias("root"), F.col("digest").alias("subroot")), "merkle-root")
    if upper:
        heads = pushed(upper, root, "source", "level").select(F.col("source").alias("tree"), "level", "proof", "root", F.col("digest").alias("subroot"))
    else:
        # One source, or none: its subroot is the root.
        heads = subroots.select("tree", "level", F.array().cast(_PAIR).alias("proof"), F.col("digest").alias("root"), F.col("digest").alias("subroot"))
    heads = written(heads, "merkle-heads")

    top = heads.where("level = 0")
    single = nodes.where("n = 1").select(F.col("tree").alias("of"), "digest", *own)
    lone = single.join(top, single["of"].eqNullSafe(top["tree"])).select("tree", "digest", "proof", "root", "subroot", *own)
    rows = lone if not levels else lone.unionByName(pushed(levels, heads, *own).select(*lone.columns))
    return rows.select("doc_id", F.col("tree").alias("source"), F.col("digest").alias("leaf"), F.col("tampered").alias("tampered_leaf"), "subroot", "root", "proof")


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = manifest(table(spark, sf_dir, "documents"))
    rows = rows.withColumn("folded_root", folded(F.coalesce("tampered_leaf", "leaf"), F.col("proof")))
    return rows.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def queries() -> dict:
    return {"op13_merkle": op13_merkle}


def _leaf_sql(text: str) -> str:
    parts = [f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in (*COLUMNS[:-1], text)]
    return f"sha256({' || '.join(parts)})"


#: CRC-32 bit by bit over the id's digits.
_CRC = "list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)), lambda r, x: list_reduce(list_prepend(xor(r, x), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::UBIGINT) ELSE v // 2 END + z))"

ORACLE = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, source, {_leaf_sql("text")} AS leaf, xor({_CRC}, 4294967295::UBIGINT) % {TAMPERED} = 0 AS hit, {_leaf_sql(f"translate(text, '{UPPER}', '{LOWER}')")} AS other FROM documents),
first AS (
  SELECT *, CASE WHEN hit THEN other ELSE leaf END AS used, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM leaves),
up AS (
  SELECT 0 AS lvl, source, pos, leaf AS d, n FROM first
  UNION ALL
  SELECT any_value(lvl) + 1, source, pos // {FAN}, sha256(string_agg(d, '' ORDER BY pos)), any_value((n + {FAN - 1}) // {FAN}) FROM up WHERE n > 1 GROUP BY source, pos // {FAN}),
tops AS (SELECT source, lvl, d, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
over AS (
  SELECT 0 AS lvl, pos, d, n FROM tops
  UNION ALL
  SELECT any_value(lvl) + 1, pos // {FAN}, sha256(string_agg(d, '' ORDER BY pos)), any_value((n + {FAN - 1}) // {FAN}) FROM over WHERE n > 1 GROUP BY pos // {FAN}),
sib AS (
  SELECT lvl, source, pos, n, coalesce(string_agg(d, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(d, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM up WINDOW w AS (PARTITION BY lvl, source, pos // {FAN} ORDER BY pos)),
over_sib AS (
  SELECT lvl, pos, n, coalesce(string_agg(d, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(d, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM over WINDOW w AS (PARTITION BY lvl, pos // {FAN} ORDER BY pos)),
steps AS (
  SELECT f.doc_id, f.leaf, f.pos AS place, f.source, s.lvl, s.l, s.r FROM first f JOIN sib s ON s.source IS NOT DISTINCT FROM f.source AND s.n > 1 AND s.pos = f.pos // ({FAN} ** s.lvl)::BIGINT
  UNION ALL
  SELECT f.doc_id, f.leaf, f.pos, f.source, 1000 + s.lvl, s.l, s.r FROM first f JOIN tops t ON t.source IS NOT DISTINCT FROM f.source JOIN over_sib s ON s.n > 1 AND s.pos = t.pos // ({FAN} ** s.lvl)::BIGINT),
proofs AS (SELECT source, place, list({{'l': l, 'r': r}} ORDER BY lvl) AS p FROM steps GROUP BY source, place),
folds AS (
  SELECT f.doc_id, f.leaf, t.d AS subroot, (SELECT d FROM over WHERE n = 1) AS root, coalesce(p, []) AS p, f.used
  FROM first f JOIN tops t ON t.source IS NOT DISTINCT FROM f.source LEFT JOIN proofs ON proofs.source IS NOT DISTINCT FROM f.source AND proofs.place = f.pos),
done AS (
  SELECT *, list_reduce(list_prepend({{'l': used, 'r': ''}}, p), lambda a, b: {{'l': sha256(b.l || a.l || b.r), 'r': ''}}).l AS folded_root FROM folds)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(p, lambda x: x.l || x.r), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM done
"""


def oracle_sql() -> dict:
    return {"op13_merkle": ORACLE}
