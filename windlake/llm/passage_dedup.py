"""Passage dedup: finds every byte in a string of LENGTH bytes that also starts elsewhere in the corpus.

A suffix array of all texts would need a round for each byte of the longest text. Here the collection is first cut into
small ones that hold all that could match: anchors (minimizers) tie each LENGTH-byte window to a place that its content
alone decides, and windows at like distances from an anchor share a core of bytes. Windows whose core occurs once match
nothing; if all windows around a core look alike, all match. The rest, for each core a small collection of the bytes
around it, goes through column-wise construction: one symbol of every member is inserted in each round, from the right,
and the order of the suffixes (the transform) and their common prefixes are updated by a sequential pass. Members whose
common prefix with a neighbour spans a window match. Collections too large for that are first split by longer cores.
"""

from __future__ import annotations

from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windlake.llm.common import Scratch, documents, small_batches, text_or_empty

LENGTH = 400
GRAM_STEPS = 7  # anchors are minimal hashes of 2**7-byte strings
WIDTHS = (32, 8, 1)  # windows to a core, from coarse to fine
MOST_MEMBERS = 256  # of a collection; larger ones are split by longer cores
_TABLE = np.random.default_rng(2).integers(1, 1 << 63, 256, dtype=np.uint64)


def gram_hashes(raw: np.ndarray, steps: int = GRAM_STEPS) -> np.ndarray:
    """64-bit hashes of all 2**steps-byte strings, by doubling."""
    h, mul = _TABLE[raw], 0x9E3779B97F4A7C15
    for s in range(steps):
        h = h[: len(h) - (1 << s)] * np.uint64(mul) + h[1 << s :]
        mul = mul * mul % (1 << 64)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each w values in a row, by minima from both ends of blocks of w."""
    n = len(x) - w + 1
    blocks = -(-len(x) // w)
    full = np.full(blocks * w, np.iinfo(x.dtype).max, x.dtype)
    full[: len(x)] = x
    grid = full.reshape(blocks, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def anchors(data: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: first window, last window, the anchor's place, its hash.

    The anchor of a window is the leftmost smallest hash in it, so equal windows have it at equal places.
    """
    gram = 1 << GRAM_STEPS
    if len(data) < length:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.int64),)
    h = gram_hashes(np.frombuffer(data, np.uint8))
    low = np.uint64(0xFFFFFFFF)
    key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    at = (sliding_min(key, length - gram + 1) & low).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:] - 1, [len(at) - 1]])
    return first, last, at[first], h[at[first]].view(np.int64)


def _list_anchors(batches):
    for batch in batches:
        sizes, hashes, times = [], [], []
        for text in batch.column("text").to_pylist():
            h, n = np.unique(anchors(text.encode())[3], return_counts=True)
            sizes.append(len(h)), hashes.append(h), times.append(n)
        of = pa.array(np.repeat(np.arange(len(sizes)), sizes), pa.int64())
        columns = [pa.array(np.concatenate(x) if x else [], pa.int64()) for x in (hashes, times)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(of) for c in ("d", "t")), *columns], ["d", "t", "hash", "times"])


def _core(level_core: bytes, *parts: bytes) -> bytes:
    h = blake2b(level_core, digest_size=16)
    for p in parts:
        h.update(len(p).to_bytes(2, "little") + p)
    return h.digest()


def blocks_of(data: bytes, hits: set[int], width: int = WIDTHS[0], length: int = LENGTH):
    """(core, place of the block's first window, first valid window, left bytes, right bytes) for windows whose anchor's hash is in hits."""
    first, last, at, hashes = anchors(data, length)
    for p1, p2, a, h in zip(first.tolist(), last.tolist(), at.tolist(), hashes.tolist()):
        if h not in hits:
            continue
        for r in range((a - p2) // width, (a - p1) // width + 1):
            b1 = a - r * width
            b0 = b1 - width + 1
            q1, q2 = max(p1, b0), min(p2, b1)
            core = blake2b(data[b1 : b0 + length], digest_size=16, salt=r.to_bytes(2, "little")).digest()
            yield core, b0, q1 - b0, data[q1:b1], data[b0 + length : q2 + length]


def split_block(core: bytes, b0: int, lead: int, left: bytes, right: bytes, width: int, finer: int):
    """The block as blocks of ``finer`` windows with longer cores: bytes around the core move into it."""
    for s in range(0, width, finer):
        lo, hi = max(s, lead), min(s + finer - 1, len(right))
        if lo > hi:
            continue
        cut = s + finer - 1 - lead  # of the left bytes before the new core
        new = _core(core, left[cut:] if cut >= 0 else left, right[:s], bytes([s]))
        yield new, b0 + s, lo - s, left[lo - lead : max(cut, 0)], right[s:hi]


def column_wise(group: np.ndarray, lefts: list[bytes], rights: list[bytes], width: int) -> np.ndarray:
    """For each member, which of its windows (columns, by place) some other member of its group has too.

    Member: left bytes, core (the group), right bytes. Symbols go in column by column from the right. ``order`` holds the
    members by what was inserted so far, ``common`` the common prefix of each with the one before it. A round sorts by
    the new symbol, stably, and two neighbours of one symbol share one symbol more than the least common prefix between
    their old places.
    """
    n, side = len(group), width - 1
    none = 256
    left, right = np.full((n, side), none, np.int64), np.full((n, side), none, np.int64)
    for i, (x, y) in enumerate(zip(lefts, rights)):
        if x:
            left[i, side - len(x) :] = np.frombuffer(x, np.uint8)
        if y:
            right[i, : len(y)] = np.frombuffer(y, np.uint8)
    n_left, n_right = np.array([*map(len, lefts)], np.int64), np.array([*map(len, rights)], np.int64)
    order, common = np.arange(n), np.zeros(n, np.int64)
    found = np.zeros((n, width), bool)

    def insert(symbol: np.ndarray) -> None:
        nonlocal order, common
        s = symbol[order]
        to = np.argsort(s, kind="stable")
        same = np.concatenate([[False], s[to][1:] == s[to][:-1]])
        least = np.zeros(n, np.int64)
        if same.any():
            lo, hi = to[np.flatnonzero(same) - 1] + 1, to[same]
            level, best, span = common, np.empty(len(lo), np.int64), hi - lo + 1
            step = np.floor(np.log2(span)).astype(np.int64)
            for k in range(int(step.max()) + 1):
                on = step == k
                best[on] = np.minimum(level[lo[on]], level[hi[on] - (1 << k) + 1])
                if k < step.max():
                    level = np.minimum(level[: len(level) - (1 << k)], level[1 << k :])
            least[same] = best + 1
        order, common = order[to], least

    for j in range(side - 1, -1, -1):
        insert(right[:, j])
    for j in range(width):  # j bytes of the left are in
        insert(group if j == 0 else left[:, side - j])
        match = common >= width
        match[:-1] |= common[1:] >= width
        place = side - j
        found[order, place] = match
        found[:, place] &= (n_left >= j) & (n_right >= place)
    return found


def _runs(mask: np.ndarray, b0: int) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return [(b0 + s, b0 + e - 1 + LENGTH) for s, e in zip(edge[::2].tolist(), edge[1::2].tolist())]


BLOCK = "core binary, d long, t long, b0 int, lead int, left binary, right binary"
SPAN = "d long, t long, start int, end int"


def _block_table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    columns = zip(*rows) if rows else [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["core", "d", "t", "b0", "lead", "left", "right"])


def _blocks(batches):
    for batch in batches:
        rows = []
        for d, t, text, hits in zip(*(batch.column(c).to_pylist() for c in ("d", "t", "text", "hits"))):
            rows += [(core, d, t, *rest) for core, *rest in blocks_of(text.encode(), set(hits))]
            if len(rows) > 20_000:
                yield _block_table(rows)
                rows = []
        yield _block_table(rows)


def _split(width: int, finer: int):
    def run(batches):
        for batch in batches:
            rows = []
            for core, d, t, b0, lead, left, right in zip(*(batch.column(c).to_pylist() for c in ("core", "d", "t", "b0", "lead", "left", "right"))):
                rows += [(new, d, t, *rest) for new, *rest in split_block(core, b0, lead, left, right, width, finer)]
            yield _block_table(rows)

    return run


SOLVE_ROWS = 8192


def _collections(width: int):
    """Rows come sorted by core; a collection that a batch may have cut is kept for the next one."""

    def solve(table: pa.Table) -> pa.RecordBatch:
        cores = table.column("core").to_pylist()
        core = np.cumsum([True, *(x != y for x, y in zip(cores, cores[1:]))])
        found = column_wise(core, table.column("left").to_pylist(), table.column("right").to_pylist(), width)
        out = []
        for d, t, b0, mask in zip(table.column("d").to_pylist(), table.column("t").to_pylist(), table.column("b0").to_pylist(), found):
            if mask.any():
                out += [(d, t, s, e) for s, e in _runs(mask, b0)]
        columns = zip(*out) if out else [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["d", "t", "start", "end"])

    def run(batches):
        rest, waiting, rows = None, [], 0
        for batch in batches:
            waiting.append(pa.Table.from_batches([batch]))
            rows += len(batch)
            if rows < SOLVE_ROWS:  # a round costs little more for many members than for few
                continue
            table = pa.concat_tables([rest, *waiting] if rest is not None else waiting)
            waiting, rows = [], 0
            core = table.column("core")
            keep, last = len(table), core[-1].as_py()
            while keep and core[keep - 1].as_py() == last:
                keep -= 1
            rest = table.slice(keep)
            if keep:
                yield solve(table.slice(0, keep))
        tables = ([rest] if rest is not None else []) + waiting
        if sum(map(len, tables)):
            yield solve(pa.concat_tables(tables))

    return run


def repeated_spans(spark: SparkSession, blocks: DataFrame, scratch: Scratch) -> DataFrame:
    """Spans (d, t, start, end) of all windows that occur more than once."""
    spans = []
    for level, width in enumerate(WIDTHS):
        look = F.xxhash64("lead", "left", "right")
        cores = blocks.groupBy("core").agg(F.count(F.lit(1)).alias("n"), F.min(look).alias("v0"), F.max(look).alias("v1")).where("n > 1")
        cores = scratch.put(cores.select("core", "n", (F.col("v0") == F.col("v1")).alias("alike")), f"cores{level}")
        met = scratch.put(blocks.join(cores, "core"), f"met{level}")
        first = F.col("b0") + F.col("lead")
        spans.append(met.where("alike").select("d", "t", first.alias("start"), (F.col("b0") + F.octet_length("right") + LENGTH).cast("int").alias("end")))
        if width == 1:
            break
        small = met.where(f"not alike and n <= {MOST_MEMBERS}").select(*BLOCK.replace(" binary", "").replace(" long", "").replace(" int", "").split(", "))
        parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        spans.append(small.repartition(parts, "core").sortWithinPartitions("core").mapInArrow(_collections(width), SPAN))
        large = met.where(f"not alike and n > {MOST_MEMBERS}").drop("n", "alike")
        blocks = scratch.put(large.mapInArrow(_split(width, WIDTHS[level + 1]), BLOCK), f"blocks{level + 1}")
    out = spans[0]
    for s in spans[1:]:
        out = out.unionAll(s)
    return out


def merged_spans(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Spans that touch or overlap as one."""
    if not len(start):
        return []
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    cut = np.flatnonzero(start[1:] > reach[:-1]) + 1
    return list(zip(start[np.append(0, cut)].tolist(), reach[np.append(cut - 1, len(reach) - 1)].tolist()))


def _remove(with_text: bool):
    def run(batches):
        for batch in batches:
            removed, runs, digests, kept_texts = [], [], [], []
            spans = batch.column("spans").fill_null([])
            offsets, flat = spans.offsets.to_numpy(), spans.values
            start, end = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("start", "end"))
            for i, text in enumerate(batch.column("text").to_pylist()):
                data, digest, kept, at, n = text.encode(), sha256(), [], 0, 0
                merged = merged_spans(start[offsets[i] : offsets[i + 1]], end[offsets[i] : offsets[i + 1]])
                for s, e in [*merged, (len(data), len(data))]:
                    digest.update(data[at:s])
                    if with_text:
                        kept.append(data[at:s])
                    at, n = e, n + e - s
                removed.append(n), runs.append(len(merged)), digests.append(digest.hexdigest()), kept_texts.append(b"".join(kept) if with_text else None)
            arrays = [pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digests, pa.string()), pa.array(kept_texts, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *arrays], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def passage_dedup(spark: SparkSession, docs: DataFrame, with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and kept (the bytes that are left, if asked for).

    A null text is empty. Rows that repeat an id and text are repeats of each other like any two rows. Null ids are kept;
    other columns are ignored; an empty table gives an empty result.
    """
    small_batches(spark, 300)
    scratch = Scratch(spark, "passages")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    d = F.coalesce(F.xxhash64("doc_id"), F.lit(0))
    text = docs.select("doc_id", text_or_empty().alias("text")).select("doc_id", d.alias("d"), F.xxhash64("text", F.col("doc_id").cast("string")).alias("t"), "text")
    listed = scratch.put(text.select("d", "t", "text").mapInArrow(_list_anchors, "d long, t long, hash long, times long"), "anchors")
    inside = listed.groupBy("hash").agg(F.sum("times").alias("n")).where("n > 1").select("hash")
    repeated = scratch.put(inside, "repeated")
    hits = listed.join(repeated, "hash").groupBy("d", "t").agg(F.collect_set("hash").alias("hits"))
    hits = scratch.put(hits, "hits")
    work = text.join(hits, ["d", "t"], "left")
    plain = F.when(F.col("hits").isNull(), F.sha2("text", 256))
    work = scratch.put(
        work.select("doc_id", "d", "t", F.octet_length("text").cast("long").alias("n_bytes"), plain.alias("kept_sha256"), F.when(F.lit(with_text) | F.col("hits").isNotNull(), F.col("text")).alias("text"), "hits"),
        "work",
    )
    scratch.drop("anchors")
    blocks = scratch.put(work.where("hits is not null").select("d", "t", "text", "hits").mapInArrow(_blocks, BLOCK), "blocks0")
    spans = repeated_spans(spark, blocks, scratch).groupBy("d", "t").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    spans = scratch.put(spans, "spans")
    done = "doc_id {}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary".format(id_type)
    touched = work.where("hits is not null").join(spans, ["d", "t"], "left").select("doc_id", "n_bytes", "text", "spans").mapInArrow(_remove(with_text), done)
    whole = work.where("hits is null").select("doc_id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), "kept_sha256", F.encode("text", "UTF-8").alias("kept"))
    return touched.unionAll(whole)


def op2_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_dedup(spark, documents(spark, sf_dir), with_text=False).drop("kept")


QUERIES = {"op2_passage_dedup": op2_passage_dedup}
ORACLE_SQL: dict[str, str] = {}
