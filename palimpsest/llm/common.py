"""What several operators share: word boundaries, table access and tables that cut lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words, as a regular expression's class: space and the five control characters 9 to 13.
SPACE = r"[\x20\x09-\x0D]"
#: A word is a run of anything else.
WORD = r"[^\x20\x09-\x0D]+"
#: The same characters, for functions that take a set of characters.
SPACE_CHARS = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor reaches: the session's checkpoint folder; where none is set, one in the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        set_to = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = set_to.get() if set_to.isDefined() else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/palimpsest"
    return named.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder, read back: computed once, and what follows survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_key(id_column: str = "doc_id") -> Column:
    """64 bits of a row's id and text: rows that agree on both are the same row for every decision; joins add the id itself."""
    return F.xxhash64(F.col(id_column), F.col("text"))
