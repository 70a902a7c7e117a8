"""Sharding by Karmarkar-Karp differencing, as a tree of bounded differencing tasks.

Equal texts are one indivisible group. Groups are dealt by hash into buckets of bounded size; each bucket is differenced
on its own into a partial partition (one total for each shard), and partial partitions are differenced again, ``fan_in``
at a time, until one is left. Only totals move up the tree, and shard numbers come down it by joins.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from windlake.llm.common import Scratch, documents, groups_for, hash_group, text_or_empty

N_SHARDS = 16


def difference(tuples: Sequence[Sequence[int]], parts: int) -> list[list[int]]:
    """Karmarkar-Karp: for each tuple of ``parts`` totals (largest first), the part that each of its places goes to.

    The two partial partitions with the largest spread are combined, the largest total of one with the smallest of the
    other, until one is left.
    """
    sums = [list(t) for t in tuples]
    heap = [(t[-1] - t[0], i) for i, t in enumerate(sums)]
    heapq.heapify(heap)
    joined: list[tuple[int, int, list[int]]] = []
    places = range(parts)
    while len(heap) > 1:
        a = heapq.heappop(heap)[1]
        b = heapq.heappop(heap)[1]
        total = [x + y for x, y in zip(sums[a], reversed(sums[b]))]
        order = sorted(places, key=total.__getitem__, reverse=True)
        sums[a] = sums[b] = []
        sums.append([total[j] for j in order])
        heapq.heappush(heap, (sums[-1][-1] - sums[-1][0], len(sums) - 1))
        joined.append((a, b, order))
    to: list[list[int]] = [[] for _ in sums]
    if sums:
        to[-1] = list(places)
    for node in range(len(sums) - 1, len(tuples) - 1, -1):
        a, b, order = joined[node - len(tuples)]
        left, right = [0] * parts, [0] * parts
        for place, j in enumerate(order):
            left[j] = right[parts - 1 - j] = to[node][place]
        to[a], to[b], to[node] = left, right, []
    return to[: len(tuples)]


def _difference_groups(parts: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["total", "key"], ascending=[False, True])
        zeros = [0] * (parts - 1)
        to = difference([[int(x), *zeros] for x in rows["total"]], parts)
        return rows.assign(part=[t[0] for t in to])[["key", "total", "bucket", "part"]]

    return run


def _difference_tuples(parts: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        nodes = sorted(rows["node"].unique())
        of = {(n, p): int(x) for n, p, x in zip(rows["node"], rows["part"], rows["total"])}
        orders = [sorted(range(parts), key=lambda p, n=n: (-of.get((n, p), 0), p)) for n in nodes]
        to = difference([[of.get((n, p), 0) for p in order] for n, order in zip(nodes, orders)], parts)
        out = [(n, p, up, of.get((n, p), 0)) for n, order, ups in zip(nodes, orders, to) for p, up in zip(order, ups)]
        return pd.DataFrame(out, columns=["node", "part", "up", "total"]).assign(parent=rows["parent"].iloc[0])[["node", "part", "parent", "up", "total"]]

    return run


def shard_groups(spark: SparkSession, groups: DataFrame, n_groups: int, shards: int = N_SHARDS, per_task: int = 8192, fan_in: int = 64) -> DataFrame:
    """Deals groups (key long, total long) into shards of near-equal totals; returns key, shard."""
    scratch = Scratch(spark, "sharding")
    buckets = groups_for(n_groups, per_task)
    cut = groups.select("key", "total", hash_group(buckets, "key", seed=1).alias("bucket"))
    cut = scratch.put(cut.groupBy("bucket").applyInPandas(_difference_groups(shards), "key long, total long, bucket int, part int"), "groups")
    tuples = cut.select(F.col("bucket").alias("node"), "part", "total").groupBy("node", "part").agg(F.sum("total").alias("total"))
    maps, width = [], buckets
    while width > 1 or not maps:
        width = -(-width // fan_in)
        up = tuples.withColumn("parent", F.floor(F.col("node") / fan_in).cast("int")).groupBy("parent")
        maps.append(scratch.put(up.applyInPandas(_difference_tuples(shards), "node int, part int, parent int, up int, total long"), f"level{len(maps)}"))
        tuples = maps[-1].groupBy(F.col("parent").alias("node"), F.col("up").alias("part")).agg(F.sum("total").alias("total"))
    shard = maps[-1].select("node", "part", F.col("up").alias("shard"))
    for level in reversed(maps[:-1]):
        above = shard.withColumnsRenamed({"node": "parent", "part": "up"})
        shard = level.select("node", "part", "parent", "up").join(above, ["parent", "up"]).select("node", "part", "shard")
    return cut.join(shard, (cut["bucket"] == shard["node"]) & (cut["part"] == shard["part"])).select("key", "shard")


def number_within(spark: SparkSession, rows: DataFrame, key: str, order: str, n_rows: int, name: str, per_task: int = 4096) -> DataFrame:
    """Adds a gapless number from 0 within each ``key``: numbers within small hash chunks plus the rows of the chunks before."""
    chunks = rows.withColumn("_chunk", hash_group(groups_for(n_rows, per_task), order, seed=2))
    before = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = chunks.groupBy(key, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    bases = bases.select(key, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(key, "_chunk").orderBy(order)
    return chunks.join(bases, [key, "_chunk"]).withColumn(name, F.col("_base") + F.row_number().over(inside) - 1).drop("_chunk", "_base")


def shard_documents(spark: SparkSession, docs: DataFrame, shards: int = N_SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deals all rows into ``shards`` of near-equal bytes; equal texts stay together.

    Returns doc_id, size (UTF-8 bytes plus 1), text_crc32, law ("bytes"), shard, slot (gapless from 0 within its shard),
    grown_shard (null under this law). A null text is empty. The group key is a 64-bit hash: a collision would only keep
    two texts together. A group larger than a fair share fills a shard of its own. Repeated rows are each placed, next
    to each other; null ids are placed like others. Other columns are ignored; an empty table gives an empty result.
    """
    scratch = Scratch(spark, "sharding-rows")
    text = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    rows = scratch.put(
        text.select("doc_id", (F.octet_length("text") + 1).cast("long").alias("size"), F.crc32("text").alias("text_crc32"), F.xxhash64("text").alias("key")),
        "rows",
    )
    n_rows = rows.count()
    groups = rows.groupBy("key").agg(F.sum("size").alias("total"))
    shard = scratch.put(shard_groups(spark, groups, n_rows, shards), "shards")
    placed = scratch.put(rows.join(shard, "key").select("doc_id", "size", "text_crc32", "shard"), "placed")
    return number_within(spark, placed, "shard", "doc_id", n_rows, "slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(spark, documents(spark, sf_dir))


QUERIES = {"op1_sharding": op1_sharding}
ORACLE_SQL: dict[str, str] = {}
