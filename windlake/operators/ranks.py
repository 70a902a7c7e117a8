"""Exact order statistics by group without sorting a group: counts by value range, then within the range that holds the rank."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from windlake.sources.scratch import Scratch

BUCKETS, ROUNDS = 1024, 3


def values_at_ranks(spark: SparkSession, counted: DataFrame, targets: DataFrame, key: str, rounds: int = ROUNDS, buckets: int = BUCKETS) -> DataFrame:
    """(key, rank, v): the value at each rank (from 0) of ``targets`` (key, rank), among the values of its key.

    ``counted`` is (key, v, c): the values of a key, each with its number of rows; v is a finite number and not missing. A
    round splits the range that still holds a rank into ``buckets`` even parts and counts them, which combines before the
    shuffle; the range then shrinks to the values of one part, so outliers cost a round and no more. What is left after the
    rounds, a part of some millionths of a key, is sorted. Ranks outside a key's rows give no row.
    """
    scratch = Scratch(spark, "ranks")
    counted = scratch.put(counted.select(F.col(key).alias("k"), F.col("v").cast("double").alias("v"), F.col("c").cast("long").alias("c")), "counted")
    wanted = targets.select(F.col(key).alias("k"), F.col("rank").cast("long").alias("rank")).distinct()
    state = counted.groupBy("k").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).join(wanted, "k").withColumn("below", F.lit(0).cast("long"))
    for n in range(rounds):
        state = scratch.put(state, f"state{n}")
        place = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * buckets), F.lit(buckets - 1))).otherwise(0)
        inside = counted.join(state, "k").where("v between lo and hi").withColumn("part", place.cast("int"))
        parts = inside.groupBy("k", "rank", "part").agg(F.sum("c").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.first("below").alias("below"))
        upto = Window.partitionBy("k", "rank").orderBy("part")  # at most as many rows as there are parts
        parts = parts.withColumn("upto", F.col("below") + F.sum("c").over(upto))
        here = (F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("c"))
        state = parts.where(here).select("k", "lo", "hi", "rank", (F.col("upto") - F.col("c")).alias("below"))
    state = scratch.put(state, "last")
    inside = counted.join(state, "k").where("v between lo and hi")
    run = inside.withColumn("upto", F.col("below") + F.sum("c").over(Window.partitionBy("k", "rank").orderBy("v")))
    return run.where("rank < upto and rank >= upto - c").select(F.col("k").alias(key), "rank", "v")
