"""Exact dedup against DuckDB and by hand."""

import random
from hashlib import sha256

from compare import assert_same
from pyspark.sql import functions as F

from windlake.llm import exact_dedup as E


def test_same_as_sql(spark, sf):
    assert_same(E.op3_exact_dedup(spark, sf), sf, E.ORACLE_SQL["op3_exact_dedup"])


def test_odd_rows(spark):
    docs = [(5, "a \t\n b"), (3, "a b"), (9, "a  b "), (4, None), (2, ""), (7, "\n"), (8, " "), (None, "a b"), (None, "only"), (3, "a b"), (6, "a b"), (1, "é" * 70_000)]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, keep_id int")
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in E.exact_dedup(spark, df).collect()), key=repr)
    want = [(5, 3, 4, False), (3, 3, 4, True), (9, 9, 1, True), (4, 2, 2, False), (2, 2, 2, True), (7, 7, 2, True), (8, 7, 2, False), (None, 3, 4, False), (None, None, 1, True), (3, 3, 4, True), (6, 6, 1, True), (1, 1, 1, True)]
    assert got == sorted(want, key=repr)
    assert {r.text_sha256 for r in E.exact_dedup(spark, df).where("doc_id = 9").collect()} == {sha256(b"a b ").hexdigest()}
    assert E.exact_dedup(spark, df.limit(0)).count() == 0


def test_any_number_of_runs(spark):
    rnd = random.Random(1)
    df = spark.createDataFrame([(i, rnd.choice("abcde")) for i in range(500)], "doc_id long, text string")
    results = {tuple(sorted(map(tuple, E.exact_dedup(spark, df, runs=r).collect()))) for r in (1, 2, 5, 8)}
    assert len(results) == 1


def test_large_groups_and_merging_without_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(E, "LARGE_GROUP", 50)
    df = spark.createDataFrame([(i, "copy" if i % 3 == 0 else f"t{i % 40}") for i in range(600)], "doc_id long, text string")
    text = {r.doc_id: r.text for r in df.collect()}
    got = {r.doc_id: (r.keep_id, r.group_size) for r in E.exact_dedup(spark, df).collect()}
    assert got == {i: (min(j for j in text if text[j] == t), sum(x == t for x in text.values())) for i, t in text.items()}
    runs = E._Runs(spark, E.Scratch(spark, "t"), 4)
    table = runs.write(df.select(F.col("text").alias("key"), (F.col("doc_id") % 2).alias("run"), "doc_id").repartition(4, "key"), 0)
    plan = table.where("run = 0").hint("merge").join(table.where("run = 1").select("key", F.col("doc_id").alias("other")), "key", "full")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
