"""What the corpus operators share: reading, scratch tables, session settings."""

from __future__ import annotations

import math
from collections.abc import Callable, Hashable
from functools import reduce
from operator import and_
from typing import TypeVar

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from windlake.sources.scratch import Scratch, shared_dir

__all__ = ["Scratch", "shared_dir"]

T = TypeVar("T")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(text: str | Column = "text") -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def groups_for(rows: int, per_group: int) -> int:
    """How many hash groups keep about ``per_group`` rows in each, at any input size."""
    return max(1, math.ceil(rows / per_group))


def hash_group(n: int, *cols: str | Column, seed: int = 0) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(n)).cast("int")


def small_batches(spark: SparkSession, rows: int = 500, size: int = 16 << 20) -> None:
    """Texts can be long: Python workers get few rows and bytes at a time, so their memory stays bounded. These are settings
    of the session, as Spark has none for a single job."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


_KEPT: dict = {}
_KEPT_OF: list = [None]


def kept_in_stage(key: Hashable, make: Callable[[], T]) -> T:
    """A value that a Python worker keeps between tasks of one stage, such as a cache. Workers outlive stages: the first call
    of another stage lets go of everything, so that a long job's stages don't add up in an executor's memory."""
    task = TaskContext.get()
    stage = task.stageId() if task else None
    if _KEPT_OF[0] != stage:
        _KEPT.clear()
        _KEPT_OF[0] = stage
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


#: Up to so many ids (8 bytes each, some tens of MB as a hash table) a join with texts may be a broadcast.
BROADCAST_IDS = 400_000


def without_keys(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of docs whose key isn't in gone (one written table with the key's columns), nulls equal to nulls: a broadcast
    while the keys are few, else a shuffle."""
    names = gone.columns
    gone = gone.toDF(*(f"_gone_{c}" for c in names))
    few = gone.count() <= BROADCAST_IDS
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_gone_{c}")) for c in names))
    return docs.join(F.broadcast(gone) if few else gone, same, "left_anti")


def one_of_each_key(spark: SparkSession, docs: DataFrame, key: list[str], name: str) -> DataFrame:
    """Of rows that repeat a key (null or not), the smallest by all columns in their order; only those rows are shuffled."""
    again = docs.groupBy(*key).count().where("count > 1").select(*key)
    again = Scratch(spark, name).put(again, "again")
    if again.isEmpty():
        return docs
    once = again.toDF(*(f"_again_{c}" for c in key))
    few = once.count() <= BROADCAST_IDS
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_again_{c}")) for c in key))
    repeated = docs.join(F.broadcast(once) if few else once, same, "left_semi")
    repeated = repeated.groupBy(*(F.col(c).alias(f"_key_{c}") for c in key)).agg(F.min(F.struct(*docs.columns)).alias("_row")).select("_row.*")
    return without_keys(docs, again).unionByName(repeated)
