"""The corpus pipeline: five stages from raw documents to packed sequences, each written and reread."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windlake.llm.common import BROADCAST_IDS, Scratch, documents, one_of_each_key, without_keys
from windlake.llm.exact_dedup import exact_dedup, text_digest
from windlake.llm.near_dedup import near_dedup
from windlake.llm.packing import pack_documents
from windlake.llm.secret_scan import redact
from windlake.llm.toxicity import fit, without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go."""
    model = fit(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return without_toxic(spark, docs, model)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, white space aside, one row with the smallest id stays (one without an id if none has one). An id that
    repeats with another text is another document."""
    dropped = exact_dedup(spark, docs).where("not kept").select("doc_id", F.unhex("text_sha256").alias("_digest")).distinct()
    dropped = Scratch(spark, "exact-stage").put(dropped, "dropped")
    left = without_keys(docs.withColumn("_digest", text_digest()), dropped)
    return one_of_each_key(spark, left, ["doc_id", "_digest"], "exact-stage").select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates, directly or by others, one row with the smallest id stays. Each row is linked by itself, so each text
    of an id that repeats is: near_dedup gets the number of a written row in the id's place. Rows without an id stay."""
    scratch = Scratch(spark, "near-stage")
    numbered = scratch.put(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    row = F.when(F.col("doc_id").isNotNull(), F.col("_row"))
    found = near_dedup(spark, numbered.select(row.alias("doc_id"), "text")).where("doc_id is not null").select(F.col("doc_id").alias("_row"), "component_id")
    found = scratch.put(found, "found")
    # a component of one needs no choice
    shared = scratch.put(found.groupBy("component_id").count().where("count > 1").select("component_id"), "shared")
    few = shared.count() <= BROADCAST_IDS
    members = found.join(F.broadcast(shared) if few else shared, "component_id").join(numbered.select("_row", "doc_id"), "_row")
    members = scratch.put(members.select("component_id", "_row", "doc_id"), "members")
    first = members.groupBy("component_id").agg(F.min(F.struct("doc_id", "_row")).alias("first")).select("component_id", F.col("first._row").alias("first"))
    first = scratch.put(first, "first")
    dropped = members.join(F.broadcast(first) if few else first, "component_id").where("_row <> first").select("_row")
    dropped = scratch.put(dropped, "dropped")
    return without_keys(numbered, dropped).select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; its secrets are masked."""
    return redact(spark, docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document in a sequence."""
    return pack_documents(spark, docs)


STAGES = [("toxicity", toxicity), ("exact dedup", exact), ("near dedup", near), ("secret scans", secrets), ("packing", packing)]

ORACLE_SQL = None  # a learnt classifier and a tokenizer are no SQL: tests/llm/test_pipeline.py holds each stage against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = documents(spark, sf_dir), Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.put(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
