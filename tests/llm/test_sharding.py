"""Sharding: its law, whole groups, gapless slots, balance, and differencing itself."""

import random
import zlib
from collections import defaultdict

from windlake.llm import sharding as S


def check(rows, docs, shards=16):
    text = defaultdict(list)
    for i, t in docs:
        text[i].append(t or "")
    assert len(rows) == len(docs)
    slots, where, size = defaultdict(list), defaultdict(set), defaultdict(int)
    for r in rows:
        t = next(t for t in text[r.doc_id] if zlib.crc32(t.encode()) == r.text_crc32)
        assert r.size == len(t.encode()) + 1 and r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
        where[t].add(r.shard)
        size[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in where.values())
    return size


def test_documents(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    size = check(S.op1_sharding(spark, sf).collect(), docs)
    assert len(size) == 16 and max(size.values()) < 1.05 * sum(size.values()) / 16


def test_many_buckets_and_levels(spark):
    rnd = random.Random(4)
    groups = [(k, rnd.randint(1, 100_000)) for k in range(3000)]
    df = spark.createDataFrame(groups, "key long, total long")
    got = dict(map(tuple, S.shard_groups(spark, df, 3000, per_task=40, fan_in=8).collect()))
    size = [sum(t for k, t in groups if got[k] == s) for s in range(16)]
    assert got.keys() == dict(groups).keys() and max(size) - min(size) < 0.001 * sum(size)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "é"), (None, "no id"), (4, "same"), (5, "same"), (4, "same"), (6, "z" * 100_000)]
    df = spark.createDataFrame([(i, t, 3) for i, t in docs], "doc_id long, text string, shard int")
    size = check(S.shard_documents(spark, df).collect(), docs)
    assert max(size.values()) == 100_001
    assert S.shard_documents(spark, df.limit(0)).count() == 0


def test_difference_balances():
    rnd = random.Random(9)
    for parts in (2, 3, 16):
        sizes = [rnd.randint(1, 10_000) for _ in range(400)]
        to = S.difference([[s, *[0] * (parts - 1)] for s in sizes], parts)
        total = [sum(s for s, t in zip(sizes, to) if t[0] == p) for p in range(parts)]
        assert max(total) - min(total) <= 200
    assert S.difference([], 4) == [] and S.difference([[5, 0, 0, 0]], 4) == [[0, 1, 2, 3]]
