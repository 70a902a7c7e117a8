"""Exact dedup: a tree merge of sorted digest runs, with DataFrame functions only.

Every row's normalised text becomes a key of its SHA-256, its byte length and a second 64-bit hash: two rows merge only
if all three agree. Rows are dealt into runs; a run is a table of distinct keys, each with its smallest id and number of
rows, in buckets by key and sorted by key inside them. In binomial rounds run i and run i + 2^r (r = 0, 1, ...) are merged
by a sort-merge join, bucket by bucket and without a shuffle, each level keeping the smaller id and the sum of rows,
until one run is left. A group of any size is one row of each run from the first, map-side combined, step on.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from windlake.llm.common import BROADCAST_IDS, Scratch, documents, text_or_empty

#: Fixed by the contract: runs of these characters count as one space.
WHITE_SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: str | Column = "text") -> Column:
    return F.regexp_replace(text_or_empty(text), WHITE_SPACE, " ")


def text_digest(text: str | Column = "text") -> Column:
    """SHA-256 of the normalised text, as exact_dedup has it."""
    return F.unhex(F.sha2(normalised(text), 256))


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One narrow row for each document: id, the text's key (48 bytes, the first 32 its SHA-256) and a row number."""
    text = docs.select(F.col(id_col).alias("doc_id"), normalised(text_col).alias("norm"))
    number = lambda c: F.unhex(F.lpad(F.hex(c), 16, "0"))
    key = F.concat(F.unhex(F.sha2("norm", 256)), number(F.octet_length("norm").cast("long")), number(F.xxhash64("norm")))
    return text.select("doc_id", key.alias("key"), F.monotonically_increasing_id().alias("row"))


class _Runs:
    """Runs as one bucketed table in the shared folder: a folder for each run, a file for each bucket. One level is kept at a time;
    the last one's table stays, as the result reads it."""

    def __init__(self, spark: SparkSession, scratch: Scratch, buckets: int):
        self.spark, self.scratch, self.buckets, self.name = spark, scratch, buckets, ""

    def write(self, rows: DataFrame, level: int) -> DataFrame:
        name = f"runs_{level}_{uuid.uuid4().hex}"
        writer = rows.write.partitionBy("run").bucketBy(self.buckets, "key").sortBy("key")
        writer.option("path", f"{self.scratch.path}/{name}").format("parquet").saveAsTable(name)
        if self.name:  # the level before, which has been read for the last time
            self.spark.sql(f"drop table {self.name}")
            self.scratch.drop(self.name)
        self.name = name
        return self.spark.table(name)


def merge_runs(spark: SparkSession, digests: DataFrame, runs: int = 8) -> DataFrame:
    """key, keep_id and group_size of all keys, from digest_rows that were written."""
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tables = _Runs(spark, Scratch(spark, "exact-dedup-runs"), buckets)
    dealt = digests.groupBy(F.pmod("row", F.lit(runs)).cast("int").alias("run"), "key").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    merged = tables.write(dealt.repartition(buckets, "key"), 0)
    step, level = 1, 1
    while step < runs:
        pairs = []
        for i in range(0, runs, 2 * step):
            one = merged.where(F.col("run") == i).drop("run")
            if i + step < runs:
                other = merged.where(F.col("run") == i + step).select("key", F.col("keep_id").alias("_id"), F.col("group_size").alias("_size"))
                both = one.hint("merge").join(other, "key", "full")
                size = F.coalesce("group_size", F.lit(0)) + F.coalesce("_size", F.lit(0))
                one = both.select("key", F.least("keep_id", "_id").alias("keep_id"), size.cast("long").alias("group_size"))
            pairs.append(one.withColumn("run", F.lit(i)))
        merged = tables.write(reduce(DataFrame.unionAll, pairs), level)
        step, level = 2 * step, level + 1
    return merged.drop("run")


#: Groups of at least so many rows are joined with their rows by a broadcast, while they are few enough.
LARGE_GROUP = 1_000


def exact_dedup(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int = 8) -> DataFrame:
    """Marks the row with the smallest id of each group of equal normalised texts.

    Returns doc_id, keep_id, group_size, kept, text_sha256, one row for each input row. A null text counts as empty.
    Rows that repeat an id and its text share one result (all ``kept`` or none) and each counts in ``group_size``. A null
    id never wins against another; a group of null ids only has a null ``keep_id`` and is kept. Other columns are ignored;
    an empty table gives an empty result.
    """
    scratch = Scratch(spark, "exact-dedup")
    digests = scratch.put(digest_rows(docs, id_col, text_col), "digests")
    merged = merge_runs(spark, digests, runs)
    large = scratch.put(merged.where(F.col("group_size") >= LARGE_GROUP), "large")
    if 0 < large.count() <= BROADCAST_IDS:
        # a large group's rows stay where they are; the others have no key with many rows
        rest = digests.join(F.broadcast(large.select("key")), "key", "left_anti").join(merged, "key")
        found = rest.unionByName(digests.join(F.broadcast(large), "key").select(*rest.columns))
    else:
        found = digests.join(merged, "key")  # more large groups than a broadcast holds: skew is left to adaptive execution
    return found.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex(F.substring("key", 1, 32))).alias("text_sha256"),
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark, documents(spark, sf_dir))


QUERIES = {"op3_exact_dedup": op3_exact_dedup}

ORACLE_SQL = {
    "op3_exact_dedup": r"""
        with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents),
        g as (select norm, min(doc_id) as keep_id, count(*) as group_size from t group by norm)
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(norm) as text_sha256
        from t join g using (norm)"""
}
