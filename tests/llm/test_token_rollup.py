"""Rollups against recounts from scratch."""

import re
from collections import Counter

import pytest
from tokenizers import Tokenizer

from windlake.llm import token_rollup as R
from windlake.llm.common import Scratch
from windlake.llm.tokens import tokenizer_path

SCHEMA = "doc_id long, source string, lang string, tokenizer string, tokens long, bytes long"


def totals(rollup):
    return {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens, r.bytes) for r in rollup.totals().collect()}


def test_signed_changes(spark):
    rollup = R.TokenRollup(spark, Scratch(spark, "t").path)
    assert totals(rollup) == {}
    batch = lambda rows: spark.createDataFrame(rows, SCHEMA)
    first = batch([(1, "a", "en", "v1", 5, 50), (2, "a", None, "v1", 7, 70), (2, "a", None, "v1", 6, 60), (None, "a", "en", "v1", 9, 9), (1, "a", "en", "v2", 8, 50)])
    assert rollup.commit("b1", first) and not rollup.commit("b1", first)
    assert totals(rollup) == {("a", "en", "v1"): (1, 5, 50), ("a", None, "v1"): (1, 7, 70), ("a", "en", "v2"): (1, 8, 50)}
    rollup.commit("b2", batch([(1, "b", "en", "v1", 4, 40), (2, None, None, "v1", None, None), (9, None, None, "v1", None, None), (3, None, "de", "v1", 1, 4)]))
    assert totals(rollup) == {("b", "en", "v1"): (1, 4, 40), (None, "de", "v1"): (1, 1, 4), ("a", "en", "v2"): (1, 8, 50)}
    rollup.commit("b3", batch([]))
    assert len(totals(rollup)) == 3
    with pytest.raises(ValueError):
        rollup.commit("b0", first)


def test_broken_commit_is_written_again(spark):
    rollup = R.TokenRollup(spark, Scratch(spark, "t").path)
    rows = spark.createDataFrame([(1, "a", "en", "v1", 5, 50)], SCHEMA)
    rows.select("doc_id", *R.GROUP, R.F.lit(7).cast("long").alias("docs"), "tokens", "bytes").write.parquet(f"{rollup.path}/ledger/b1")
    assert rollup.commit("b1", rows) and totals(rollup) == {("a", "en", "v1"): (1, 5, 50)}


def test_op9(spark, sf):
    tok = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    want, seen = Counter(), {}
    docs = sorted(spark.read.parquet(f"{sf}/documents.parquet").collect(), key=lambda r: r.doc_id)
    for r in docs:
        norm = re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")
        if norm not in seen:
            seen[norm] = r.doc_id
            for k, v in (("docs", 1), ("tokens", len(tok.encode(r.text or "", add_special_tokens=False).ids)), ("bytes", len((r.text or "").encode()))):
                want[r.source, r.lang, k] += v
    got = Counter()
    for r in R.op9_token_rollup(spark, sf).collect():
        got |= Counter({(r.source, r.lang, k): r[k] for k in R.MEASURES})
    assert got == want


def test_op9_counts_every_text_of_an_id(spark, tmp_path):
    tok = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    rows = [(7, "only here"), (7, "in both"), (7, "in both"), (3, "in both"), (None, "without an id"), (None, "in  both"), (8, "x"), (8, "longer than x")]
    spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    left = ["only here", "in both", "without an id", "x", "longer than x"]
    want = (len(left), sum(len(tok.encode(t, add_special_tokens=False).ids) for t in left), sum(map(len, left)))
    assert [tuple(r[m] for m in R.MEASURES) for r in R.op9_token_rollup(spark, str(tmp_path)).collect()] == [want]
