"""Connected components by contraction: every vertex hooks onto its smallest neighbour, paths are halved, edges follow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windlake.sources.scratch import Scratch


def connected_components(spark: SparkSession, edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """vertex, component (the smallest vertex it is connected with) for every vertex that has an edge.

    Each round keeps only edges between different roots, so the work shrinks; a vertex of any degree is one row after
    map-side combining. Rounds are written tables: about log2 of the longest path of them.
    """
    scratch = Scratch(spark, "components")
    left, right = F.col(a).alias("u"), F.col(b).alias("v")
    live = scratch.put(edges.select(left, right).where("u <> v").distinct(), "edges0")
    labels = scratch.put(edges.select(F.explode(F.array(F.col(a), F.col(b))).alias("vertex")).distinct().withColumn("component", F.col("vertex")), "labels0")
    for n in range(1, max_rounds + 1):
        if live.isEmpty():
            return labels
        both = live.select("u", "v").unionAll(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hook = both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("old"), F.least("u", "v").alias("new"))
        hook = scratch.put(hook, f"hook{n}")
        for half in ("a", "b"):
            up = hook.select(F.col("old").alias("new"), F.col("new").alias("up"))
            hook = scratch.put(hook.join(up, "new", "left").select("old", F.coalesce("up", "new").alias("new")), f"hook{n}{half}")
        labels = scratch.put(labels.join(hook, labels["component"] == hook["old"], "left").select("vertex", F.coalesce("new", "component").alias("component")), f"labels{n}")
        of_u, of_v = hook.toDF("u", "nu"), hook.toDF("v", "nv")
        live = live.join(of_u, "u").join(of_v, "v").select(F.col("nu").alias("u"), F.col("nv").alias("v")).where("u <> v").distinct()
        live = scratch.put(live, f"edges{n}")
        for old in (f"hook{n}", f"hook{n}a", f"hook{n}b", f"labels{n - 1}", f"edges{n - 1}"):
            scratch.drop(old)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
