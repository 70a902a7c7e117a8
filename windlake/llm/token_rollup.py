"""Token counts: rollups by source, language and tokenizer version, kept by signed deltas and idempotent batch commits.

A batch says what is true of some documents from now on (a count, or that they are gone). Against the ledger of earlier
batches it becomes signed rows: the old count is taken back, the new one added. A commit writes the batch's signed rows
and then their sums by group, each under the batch's own name: a repeated commit changes nothing, and one that broke off
is written again from the batches before it. Totals are the sum of all committed batches' small sum tables.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windlake.llm.common import Scratch, documents, small_batches, text_or_empty
from windlake.llm.exact_dedup import exact_dedup, text_digest
from windlake.llm.tokens import encoder, tokenizer_path

GROUP = ["source", "lang", "tokenizer"]
MEASURES = ["docs", "tokens", "bytes"]
#: What names a document: its id, or, where one id may have several texts, or none, its id and its text's digest.
BY_ID = ("doc_id",)
BY_TEXT = ("doc_id", "digest")


class TokenRollup:
    """A rollup in a shared folder; ``key`` are the columns that name a document."""

    def __init__(self, spark: SparkSession, path: str, key: tuple[str, ...] = BY_ID):
        self.spark, self.path, self.key = spark, path, key

    def _committed(self) -> list[str]:
        """Batches whose sums are complete, in the order of their names."""
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/sums")
        fs = fs_path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(fs_path):
            return []
        names = [s.getPath() for s in fs.listStatus(fs_path)]
        done = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(p.getName() for p in names if fs.exists(done(p, "_SUCCESS")))

    def current(self, batches: list[str], only: DataFrame | None = None) -> DataFrame | None:
        """What the ledger says of each document after these batches, or only of the keys and tokenizers in ``only`` (columns
        with the prefix _new_): then no other rows of the ledger are aggregated."""
        if not batches:
            return None
        log = self.spark.read.parquet(*(f"{self.path}/ledger/{b}" for b in batches))
        if only is not None:
            same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_new_{c}")) for c in (*self.key, "tokenizer")))
            log = log.join(only, same, "left_semi")
        state = log.groupBy(*self.key, *GROUP).agg(*(F.sum(m).alias(m) for m in MEASURES))
        return state.where("docs > 0")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Commits changes (the key, GROUP, tokens, bytes; null tokens: the document is gone); False if the batch was committed before.

        Batches apply in the order of their names. Rows whose key is null throughout are left out: nothing could
        ever revise them. Of several changes to one document and tokenizer in a batch, the one with the most tokens holds; an
        insert of a known document is a revision, and a delete of an unknown one does nothing.
        """
        done = self._committed()
        if batch in done:
            return False
        if done and batch < done[-1]:
            raise ValueError(f"batch {batch} comes after {done[-1]} by time but not by name")
        what = F.struct("tokens", "bytes", "source", "lang")
        new = changes.where(reduce(or_, (F.col(k).isNotNull() for k in self.key))).groupBy(*self.key, "tokenizer").agg(F.max(what).alias("new"))
        scratch = Scratch(self.spark, "token-rollup-batch")
        new = scratch.put(new, "new")  # read twice below; counting tokens twice would double the work
        signed = [new.where("new.tokens is not null").select(*self.key, "new.source", "new.lang", "tokenizer", F.lit(1).cast("long").alias("docs"), F.col("new.tokens").cast("long").alias("tokens"), F.col("new.bytes").cast("long").alias("bytes"))]
        revised = new.select(*(F.col(c).alias(f"_new_{c}") for c in (*self.key, "tokenizer")))
        back = self.current(done, revised)
        if back is not None:
            signed.append(back.select(*self.key, *GROUP, *((-F.col(m)).alias(m) for m in MEASURES)))
        rows = signed[0] if len(signed) == 1 else signed[0].unionByName(signed[1])
        rows.write.mode("overwrite").parquet(f"{self.path}/ledger/{batch}")
        log = self.spark.read.schema(rows.schema).parquet(f"{self.path}/ledger/{batch}")
        log.groupBy(*GROUP).agg(*(F.sum(m).alias(m) for m in MEASURES)).write.mode("overwrite").parquet(f"{self.path}/sums/{batch}")
        scratch.drop("new")
        return True

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs, tokens, bytes over all committed batches; groups without documents are gone."""
        done = self._committed()
        if not done:
            return self.spark.createDataFrame([], "source string, lang string, tokenizer string, docs long, tokens long, bytes long")
        sums = self.spark.read.parquet(*(f"{self.path}/sums/{b}" for b in done))
        return sums.groupBy(*GROUP).agg(*(F.sum(m).alias(m) for m in MEASURES)).where("docs > 0")


def token_counts(spark: SparkSession, docs: DataFrame, path: str, kind: str, tokenizer: str, key: tuple[str, ...] = BY_ID) -> DataFrame:
    """Changes that give each document's count by a tokenizer."""
    small_batches(spark)

    def run(batches):
        for batch in batches:
            enc = encoder(path, kind)
            text = batch.column("text").to_pylist()
            counts, sizes = [len(x) for x in enc.encode(text)], [len(t.encode()) for t in text]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in (*key, "source", "lang")] + [pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], [*key, "source", "lang", "tokens", "bytes"])

    rows = docs.select(*key, F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), text_or_empty().alias("text"))
    key_types = ", ".join(f"{k} {docs.schema[k].dataType.simpleString()}" for k in key)
    return rows.mapInArrow(run, f"{key_types}, source string, lang string, tokens long, bytes long").select(*key, "source", "lang", F.lit(tokenizer).alias("tokenizer"), "tokens", "bytes")


def estimates(docs: DataFrame, tokenizer: str, key: tuple[str, ...] = BY_ID) -> DataFrame:
    """Changes with the count that is assumed on arrival, before a text is tokenized: a token for each four bytes."""
    size = F.octet_length(text_or_empty()).cast("long")
    return docs.select(*key, F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.lit(tokenizer).alias("tokenizer"), F.ceil(size / 4).cast("long").alias("tokens"), size.alias("bytes"))


def removals(ids: DataFrame, tokenizer: str, key: tuple[str, ...] = BY_ID) -> DataFrame:
    """Changes that say these documents are gone."""
    none = [F.lit(None).cast(t).alias(c) for c, t in (("source", "string"), ("lang", "string"))]
    return ids.select(*key, *none, F.lit(tokenizer).alias("tokenizer"), *(F.lit(None).cast("long").alias(c) for c in ("tokens", "bytes")))


def op9_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive with estimated counts; exact counts revise them (and that batch is delivered twice); then the
    rows that repeat an earlier document's text are deleted. Returns the totals that are left. A document is an id (which
    may be null) with a text, white space aside: an id with several texts has all of them counted and deleted apart."""
    docs, name = documents(spark, sf_dir), "byte_bpe_50k"
    docs = docs.withColumn("digest", text_digest())
    rollup = TokenRollup(spark, Scratch(spark, "token-rollup").path, BY_TEXT)
    rollup.commit("1-arrivals", estimates(docs, name, BY_TEXT))
    counts = token_counts(spark, docs, tokenizer_path(f"{name}.json"), "byte", name, BY_TEXT)
    rollup.commit("2-counts", counts)
    rollup.commit("2-counts", counts)
    copies = exact_dedup(spark, docs).where("not kept").select("doc_id", F.unhex("text_sha256").alias("digest")).distinct()
    rollup.commit("3-copies", removals(copies, name, BY_TEXT))
    return rollup.totals()


QUERIES = {"op9_token_rollup": op9_token_rollup}
ORACLE_SQL: dict[str, str] = {}
