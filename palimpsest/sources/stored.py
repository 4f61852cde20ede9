"""Results that several branches of a plan read, written once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def stored(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the checkpoint folder (or the warehouse, where none is set), read back.

    What is dear is computed once, and random values stay the same for every reader, also after an executor is lost.
    """
    spark = df.sparkSession
    checkpoints = spark.sparkContext._jsc.sc().getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None) or (checkpoints.get() if checkpoints.isDefined() else spark.conf.get("spark.sql.warehouse.dir"))
    path = f"{folder.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
