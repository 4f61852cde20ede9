"""Concurrent saves of session vaults: writers compare the version they read, and those that lose try again on the new one.

All saves of a session that are at hand compete. In each round every pending save has read some version; of those that read the
current one the first by order is stored and raises the version by one, and the others read that version for their next try. A
save that has tried ``attempts`` times in vain ends as a conflict. Rounds need no loop: the first round is won by the first save
that read the stored version, each later round by the first one left, so a save's round follows from its rank.

What a save brings are values. On the version that it is stored on, values that have a number keep it and the others continue the
session's counter of their family; so the vault is the same as if the saves had come one after another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tokens import family

ATTEMPTS = 3


def judged(saves: DataFrame, versions: DataFrame, attempts: int = ATTEMPTS) -> DataFrame:
    """saves with status (saved or conflict), tries and payload_version (after the save; null for a conflict).

    saves: session_id, save_id, base_version (what it read; null: no vault), in the order of save_id. versions: session_id,
    payload_version; a session without a row has no vault, version 0.
    """
    now = versions.select(F.col("session_id").alias("_s"), F.col("payload_version").alias("_now"))
    met = saves.join(now, F.col("session_id").eqNullSafe(F.col("_s")), "left").withColumn("_now", F.coalesce("_now", F.lit(0).cast("long"))).drop("_s")
    session = Window.partitionBy("session_id")
    fresh = met.withColumn("_fresh", F.coalesce("base_version", F.lit(0).cast("long")) == F.col("_now"))
    first = F.min(F.when(F.col("_fresh"), F.col("save_id"))).over(session)
    won = fresh.withColumns({"_first": F.coalesce(F.col("save_id") == first, F.lit(False)), "_any": first.isNotNull()})
    round_ = F.when(F.col("_first"), F.lit(1)).otherwise(F.row_number().over(Window.partitionBy("session_id", "_first").orderBy("save_id")) + 1)
    ranked = won.withColumn("_round", round_)
    ok = F.col("_round") <= attempts
    # Without a winner in the first round, the second is the first to raise the version.
    version = F.col("_now") + F.col("_round") - F.when(F.col("_any"), 0).otherwise(1)
    return ranked.withColumns({
        "status": F.when(ok, "saved").otherwise("conflict"), "tries": F.least(F.col("_round"), F.lit(attempts)), "payload_version": F.when(ok, version.cast("long")),
    }).drop("_now", "_fresh", "_first", "_any", "_round")


def folded(tokens: DataFrame, outcome: DataFrame, values: Column | str = "values") -> DataFrame:
    """The vaults after the saves: session_id, matched, gen_key, seq, payload_version (that added the value; null: was there).

    tokens: session_id, matched, gen_key, seq of the stored vaults. outcome: judged saves with ``values``,
    array<struct<matched, pattern>> in the order in which the request met them.
    """
    brought = outcome.where("status = 'saved'").select("session_id", "payload_version", F.posexplode(values).alias("nth", "x"))
    firsts = brought.groupBy("session_id", F.col("x.matched").alias("matched")).agg(F.min(F.struct("payload_version", "nth")).alias("ord"), F.min_by("x.pattern", F.struct("payload_version", "nth")).alias("pattern"))
    old = tokens.select("session_id", "matched", "gen_key", F.col("seq").cast("long").alias("seq"), F.lit(None).cast("long").alias("payload_version"))
    new = firsts.join(old.select("session_id", "matched"), ["session_id", "matched"], "left_anti").withColumn("gen_key", family(F.col("pattern")))
    last = old.groupBy(F.col("session_id").alias("_s"), F.col("gen_key").alias("_k")).agg(F.max("seq").alias("_last"))
    met = new.join(last, (F.col("session_id") == F.col("_s")) & (F.col("gen_key") == F.col("_k")), "left")
    rank = F.row_number().over(Window.partitionBy("session_id", "gen_key").orderBy("ord"))
    numbered = met.withColumn("seq", (F.coalesce("_last", F.lit(0)) + rank).cast("long"))
    return old.unionByName(numbered.select("session_id", "matched", "gen_key", "seq", F.col("ord.payload_version").alias("payload_version")))
