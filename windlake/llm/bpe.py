"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over a text's bytes decides where chunks end, so shared passages give shared chunks wherever they stand.
The chunks that save the most work (bounded number and length) are encoded once for the whole corpus and sent to all
workers; any other chunk is encoded where it is met, and kept for a while. A chunk may end inside a word: what lies between the nearest white space on both sides of a join is encoded anew, together
with the units before and after it. Where that disagrees with what the chunks say of those units, more of them are
encoded anew, and at last the whole text, until both agree.
"""

from __future__ import annotations

import re
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windlake.llm.common import Scratch, documents, kept_in_stage, small_batches, text_or_empty
from windlake.llm.tokens import UnitEncoder, encoder, tokenizer_path

WINDOW_STEPS = 5  # the rolling hash covers 2**5 bytes
MASK = np.uint32((1 << 10) - 1)  # a chunk ends at one place in 1024
LONGEST = 8192
DICTIONARY = 4096  # chunks encoded once for all workers: at most DICTIONARY * LONGEST bytes of text
OWN_BYTES = 8 << 20  # of the text of chunks that a worker keeps besides
REACHES = (1, 8)  # units on either side of a join that must agree; then the whole text is encoded anew
_TABLE = np.random.default_rng(20).integers(1, 1 << 32, 256, dtype=np.uint32)


def chunk_ends(data: bytes) -> list[int]:
    """Where chunks end, never inside a UTF-8 character, at most LONGEST + 3 bytes apart; the last is the length."""
    n = len(data)
    ends: list[int] = []
    if n > 1 << WINDOW_STEPS:
        raw = np.frombuffer(data, np.uint8)
        h, mul = _TABLE[raw], 0x9E3779B1
        for step in range(WINDOW_STEPS):
            h = h[: len(h) - (1 << step)] * np.uint32(mul) + h[1 << step :]
            mul = mul * mul % (1 << 32)
        h ^= h >> np.uint32(15)
        ends = (np.flatnonzero((h & MASK) == 0) + (1 << WINDOW_STEPS)).tolist()
    out, last = [], 0
    for end in [*ends, n]:
        while end - last > LONGEST:
            last = _character_start(data, last + LONGEST)
            out.append(last)
        end = _character_start(data, end)
        if end > last:
            out.append(end)
            last = end
    return out


def _character_start(data: bytes, at: int) -> int:
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return at


def _digest(data: bytes) -> bytes:
    return blake2b(data, digest_size=16).digest()


class Chunk(NamedTuple):
    """The text before its first white space, the text and ids between, and the text after its last white space; without
    white space all of it is ``left`` and ``right`` is None."""

    left: str
    middle: str
    ids: bytes
    right: str | None


SPACES = re.compile(r"[ \n]")


def encode_chunks(enc: UnitEncoder, texts: list[str]) -> list[Chunk]:
    cut = []
    for text in texts:
        first = SPACES.search(text)
        if first is None:
            cut.append((text, "", None))
        else:
            last = max(text.rfind(" "), text.rfind("\n"))
            cut.append((text[: first.start()], text[first.end() : last] if last > first.start() else "", text[last + 1 :]))
    ids = enc.encode([middle for _, middle, _ in cut])
    return [Chunk(left, middle, x.astype("<u4").tobytes(), right) for (left, middle, right), x in zip(cut, ids)]


class ChunkEncoder:
    """Ids of whole texts from chunks; ``shared`` has those that were encoded for all workers."""

    def __init__(self, enc: UnitEncoder, shared: dict[bytes, Chunk]):
        self.enc, self.shared, self.own, self.size = enc, shared, {}, 0

    def _chunks(self, texts: list[str]) -> list[list[Chunk]]:
        keys, missing = [], {}
        for text in texts:
            data, start, mine = text.encode(), 0, []
            for end in chunk_ends(data):
                part = data[start:end]
                key, start = _digest(part), end
                mine.append(key)
                if key not in self.shared and key not in self.own:
                    missing[key] = part
            keys.append(mine)
        if self.size > OWN_BYTES:
            gone = [k for k in self.own if k not in {x for mine in keys for x in mine}]
            for k in gone:
                del self.own[k]
            self.size = 0
        self.own.update(zip(missing, encode_chunks(self.enc, [x.decode() for x in missing.values()])))
        self.size += sum(map(len, missing.values()))
        return [[self.shared.get(k) or self.own[k] for k in mine] for mine in keys]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        found: list[list] = []  # of each text: joins and ids in turn, a join being (units before, text, units after)
        joins: list[tuple[int, int]] = []
        for n, chunks in enumerate(self._chunks(texts)):
            parts, open_, before = [], "", ""
            for c in chunks:
                open_ += c.left
                if c.right is not None:
                    parts += [(before, open_, c.middle), np.frombuffer(c.ids, "<u4")]
                    open_, before = c.right, c.middle
            parts.append((before, open_, ""))
            found.append(parts)
            joins += [(n, k) for k in range(0, len(parts), 2)]
        wrong = self._repair(found, joins, REACHES[0])
        for reach in REACHES[1:]:
            wrong = self._repair(found, wrong, reach) if wrong else wrong
        for n in {n for n, _ in wrong}:
            found[n] = [np.array(self.enc.tok.encode(texts[n], add_special_tokens=False).ids, "<u4")]
        return [np.concatenate(parts) for parts in found]

    def _repair(self, found: list[list], joins: list[tuple[int, int]], reach: int) -> list[tuple[int, int]]:
        """Replaces joins by their ids where a window of ``reach`` more units on both sides agrees; the others are returned."""
        windows, alone = [], []
        for n, k in joins:
            before, text, after = found[n][k]
            near = [*before.rsplit(None, reach)[-reach:], text, *after.split(None, reach)[:reach]]
            windows.append(" ".join(near))
            alone.append(text)
        both = self.enc.tok.encode_batch_fast(windows + alone, add_special_tokens=False)
        wrong = []
        for (n, k), window, ids in zip(joins, both, both[len(joins) :]):
            parts = found[n]
            left = parts[k - 1] if k else NO_IDS
            right = parts[k + 1] if k + 1 < len(parts) else NO_IDS
            w, x = window.ids, ids.ids
            agree = any(
                w[a : a + len(x)] == x and a <= len(left) and len(w) - a - len(x) <= len(right) and left[len(left) - a :].tolist() == w[:a] and right[: len(w) - a - len(x)].tolist() == w[a + len(x) :]
                for a in range(len(w) - len(x) + 1)
            )
            if agree:
                parts[k] = np.array(x, "<u4")
            else:
                wrong.append((n, k))
        return wrong


NO_IDS = np.zeros(0, "<u4")


def _list_chunks(batches):
    for batch in batches:
        of, digest, start, length = [], [], [], []
        for i, text in enumerate(batch.column("text").to_pylist()):
            data, last = text.encode(), 0
            for end in chunk_ends(data):
                of.append(i), digest.append(_digest(data[last:end])), start.append(last), length.append(end - last)
                last = end
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(pa.array(of, pa.int64())), pa.array(digest, pa.binary()), pa.array(start, pa.int64()), pa.array(length, pa.int64())],
            ["doc_id", "digest", "start", "length"],
        )


SHARED = ["digest", "left", "middle", "ids", "right"]
SHARED_SQL = "digest binary, left string, middle string, ids binary, right string"


def _encode_shared(path: str):
    def run(batches):
        for batch in batches:
            pairs = zip(batch.column("digest").to_pylist(), batch.column("data").to_pylist())
            pairs = [(d, x) for d, x in pairs if d == _digest(x)]  # an id can stand for two texts
            found = encode_chunks(encoder(path, "word"), [x.decode() for _, x in pairs])
            rows = [(d, *c) for (d, _), c in zip(pairs, found)]
            columns = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.string(), pa.string(), pa.binary(), pa.string()))], SHARED)

    return run


def shared_chunks(spark: SparkSession, docs: DataFrame, path: str, most: int = DICTIONARY) -> dict[bytes, Chunk]:
    """The ``most`` chunks that save the most bytes of encoding, encoded once. Only a bound on reuse, not on results."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    chunks = docs.mapInArrow(_list_chunks, f"doc_id {id_type}, digest binary, start long, length long")
    counted = chunks.where(F.col("doc_id").isNotNull()).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "start", "length")).alias("at"))
    saved = (F.col("n") - 1) * F.col("at.length")
    best = counted.where("n > 1").orderBy(saved.desc(), "digest").limit(most).select("digest", "at.*")
    best = Scratch(spark, "bpe").put(best, "best")
    piece = docs.join(F.broadcast(best), "doc_id").select("digest", F.expr("substring(encode(text, 'UTF-8'), cast(start as int) + 1, cast(length as int))").alias("data"))
    piece = piece.dropDuplicates(["digest", "data"])  # rows may repeat an id
    rows = piece.mapInArrow(_encode_shared(path), SHARED_SQL).collect()
    return {bytes(r["digest"]): Chunk(r["left"], r["middle"], bytes(r["ids"]), r["right"]) for r in rows}


def _encode(path: str, shared):
    def run(batches):
        for batch in batches:
            enc = kept_in_stage(("chunks", path), lambda: ChunkEncoder(encoder(path, "word"), shared.value))
            tokens = kept_in_stage(("tokens", path), lambda: _token_texts(enc.enc))
            ids = enc.encode(batch.column("text").to_pylist())
            ends = np.cumsum([0, *map(len, ids)])
            flat = np.concatenate([NO_IDS, *ids])
            words = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), tokens.take(pa.array(flat, pa.uint32())))
            decoded = pc.binary_join(words, " ")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x.tobytes() for x in ids], pa.binary()), decoded], ["doc_id", "ids", "decoded"])

    return run


def _token_texts(enc: UnitEncoder) -> pa.Array:
    """The text of each id. This tokenizer has no decoder of its own: decoding puts tokens together with spaces."""
    if enc.tok.decoder is not None:
        raise ValueError("a tokenizer file without a decoder is expected")
    return pa.array([enc.tok.id_to_token(i) for i in range(enc.tok.get_vocab_size())], pa.string())


def encode_decode(spark: SparkSession, docs: DataFrame, path: str | None = None, most: int = DICTIONARY) -> DataFrame:
    """Encodes each whole text and decodes its ids: doc_id, ids (little-endian unsigned 32-bit), decoded.

    A null or empty text has no ids and decodes to an empty text. Repeated rows give repeated results; null ids are
    encoded like others; other columns are ignored; an empty table gives an empty result.
    """
    small_batches(spark)
    path = path or tokenizer_path("word_bpe_49k.json")
    text = docs.select("doc_id", text_or_empty().alias("text"))
    shared = spark.sparkContext.broadcast(shared_chunks(spark, text, path, most))
    return text.mapInArrow(_encode(path, shared), f"doc_id {text.schema['doc_id'].dataType.simpleString()}, ids binary, decoded string")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_decode(spark, documents(spark, sf_dir))
    return coded.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op10_bpe": op10_bpe}
ORACLE_SQL: dict[str, str] = {}
