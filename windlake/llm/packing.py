"""Packing: first-fit decreasing with a tournament tree of bin capacities, in randomised groups of documents.

A document's ids are cut into full sequences and one rest; the rests are dealt by hash into groups of bounded size, and
each group is packed on its own. Only (id, start, length) rows are shuffled, never token ids.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windlake.llm.common import Scratch, documents, groups_for, hash_group, small_batches, text_or_empty
from windlake.llm.tokens import encoder, tokenizer_path

SEQUENCE = 2048
END_ID = 1


def first_fit_decreasing(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each size. An inner node of the tree holds the larger room of its two children, so the first
    bin with room is found, and its room updated, in a walk of the tree's height."""
    leaves = 1 << max(1, (len(sizes) - 1).bit_length())
    room = [capacity] * (2 * leaves)
    bins, offsets = [0] * len(sizes), [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size, node = sizes[i], 1
        while node < leaves:
            node *= 2
            if room[node] < size:
                node += 1
        bins[i], offsets[i] = node - leaves, capacity - room[node]
        room[node] -= size
        while node > 1:
            node //= 2
            best = room[2 * node] if room[2 * node] > room[2 * node + 1] else room[2 * node + 1]
            if room[node] == best:
                break
            room[node] = best
    return bins, offsets


PIECES = "doc_id {id}, start long, length long, doc_tokens long, ids binary, ids_crc32 long"


def _cut(path: str, kind: str, capacity: int, end_id: int | None, with_ids: bool):
    def run(batches):
        for batch in batches:
            enc = encoder(path, kind)
            of, start, length, total, ids, crc = [], [], [], [], [], []
            for i, x in enumerate(enc.encode(batch.column("text").to_pylist())):
                if end_id is not None:
                    x = np.append(x, np.uint32(end_id))
                for s in range(0, len(x), capacity):
                    piece = x[s : s + capacity].astype("<u4", copy=False).tobytes()
                    of.append(i), start.append(s), length.append(len(piece) // 4), total.append(len(x)), ids.append(piece if with_ids else None), crc.append(zlib.crc32(piece))
            longs = [pa.array(x, pa.int64()) for x in (start, length, total)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(of, pa.int64())), *longs, pa.array(ids, pa.binary()), pa.array(crc, pa.int64())],
                ["doc_id", "start", "length", "doc_tokens", "ids", "ids_crc32"],
            )

    return run


def token_pieces(spark: SparkSession, docs: DataFrame, path: str, kind: str = "byte", capacity: int = SEQUENCE, end_id: int | None = END_ID, with_ids: bool = True) -> DataFrame:
    """Each document's ids (little-endian unsigned 32-bit; only their CRC-32 if not asked for), cut at multiples of ``capacity``."""
    small_batches(spark)
    text = docs.select("doc_id", text_or_empty().alias("text"))
    return text.mapInArrow(_cut(path, kind, capacity, end_id, with_ids), PIECES.format(id=docs.schema["doc_id"].dataType.simpleString()))


def _pack(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        bins, offsets = first_fit_decreasing(table.column("length").to_pylist(), capacity)
        group = table.column("_group")[0].as_py()
        table = table.drop_columns(["_group"])
        return table.append_column("sequence_id", pa.array([(group << 32) + b for b in bins], pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))

    return run


def pack_pieces(pieces: DataFrame, n_rows: int, row: str, capacity: int = SEQUENCE, per_group: int = 8192, seed: int = 4) -> DataFrame:
    """Adds sequence_id and offset to pieces with a ``length`` of at most ``capacity``. Groups are drawn by ``row``, a number
    that no two pieces share, so that no id, null or often repeated, makes a large group; it is dropped."""
    n = groups_for(n_rows, per_group)
    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields if f.name != row]
    grouped = pieces.withColumn("_group", hash_group(n, row, seed=seed).cast("long")).drop(row).groupBy("_group")
    return grouped.applyInArrow(_pack(capacity), ", ".join([*columns, "sequence_id long", "offset long"]))


def pack_documents(spark: SparkSession, docs: DataFrame, path: str | None = None, capacity: int = SEQUENCE) -> DataFrame:
    """Packs all documents, cut into pieces, into sequences of at most ``capacity`` tokens.

    Returns one row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. A null text is
    empty and is the end id alone. Repeated rows are packed each on their own; null ids are packed like others; other
    columns are ignored; an empty table gives an empty result. Sequence ids are unique, not gapless.
    """
    pieces = token_pieces(spark, docs, path or tokenizer_path("byte_bpe_50k.json"), capacity=capacity, with_ids=False)
    rows = pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.monotonically_increasing_id().alias("_row"))
    rows = Scratch(spark, "packing").put(rows, "pieces")  # written: a row keeps its number
    return pack_pieces(rows, rows.count(), "_row", capacity)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark, documents(spark, sf_dir))


QUERIES = {"op4_packing": op4_packing}
ORACLE_SQL: dict[str, str] = {}
