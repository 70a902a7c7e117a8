"""Documents joined by the Jaccard similarity of their 5-word shingles, as T-occurrence search over inverted lists.

Two sets of n and m shingles at 0.8 or more share at least four ninths of n + m. Three rounds bring each document's search
down to the lists that can matter, none of which sends a list's members to each other:

1. Of each set, in the order of its hashes, a window of about three tenths goes to its shingles' owners, one entry for each
   block of documents. Partners must meet several times inside their windows; sets that meet nobody so often go.
2. The whole sets left are counted, again one entry for each block and shingle. A set that lacks enough shared shingles
   goes; the others learn which of their lists are short.
3. Each set is held against the first member of its longest and of its shortest short list, which makes one component of
   a dense group at linear cost. Sets that still share a short list with another component are searched with DivideSkip: a
   heap merges the short lists of a query and skips, long ones are probed by binary search, and who reaches the overlap is
   linked. A family of documents is one task while it is small, and pairs of blocks beyond that.

Texts with equal sets are one class, so copies never meet each other in a list.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windlake.llm.common import BROADCAST_IDS, Scratch, documents, groups_for, hash_group, kept_in_stage, small_batches, text_or_empty
from windlake.llm.tokens import UnitHashes
from windlake.operators.components import connected_components

WORDS = 5
BUCKET = 1_000_000  # shingles that one task counts
BLOCK_SETS, BLOCK_SHINGLES = 2_000, 1_000_000  # of a family, in one task
MU = 0.0085  # published weight of a heap step against a probe, for the number of long lists

_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def least_overlap(n):
    """What a set of n shares with any partner."""
    return (4 * n + 4) // 5


def required(n, m):
    """What sets of n and m share at a similarity of 0.8: 100 c >= 80 (n + m - c)."""
    return (4 * (n + m) + 8) // 9


def window_length(n):
    """Partners' windows share more than a tenth of the smaller set: their whole sets share least_overlap, and each window
    leaves out so many fewer."""
    return n - least_overlap(n) + n // 10 + 1


def least_meetings(n):
    """As a partner has 0.8 n shingles at least, its window's share is n * 0.08 at least."""
    return 2 * n // 25 + 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Each text's sorted distinct 64-bit shingle hashes; all words of a batch are hashed at once."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = _LOWER[np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    black = ~_SPACE[raw]
    starts, ends = black.copy(), black.copy()
    starts[1:] &= ~black[:-1]
    ends[:-1] &= ~black[1:]
    first_bytes = offsets[:-1][offsets[:-1] < offsets[1:]]
    starts[first_bytes] = black[first_bytes]
    last = first_bytes[1:] - 1
    ends[last] = black[last]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    bounds = np.searchsorted(starts, offsets)
    if not len(starts):
        return [np.zeros(0, np.uint64)] * len(texts)
    one, two = kept_in_stage("words", UnitHashes)(raw, starts, ends)
    h = _mix(_mix(one) * _ODD + two)
    rolled = np.full(max(0, len(h) - WORDS + 1), WORDS, np.uint64)
    for i in range(WORDS):
        rolled = _mix(rolled * _ODD + h[i : i + len(rolled)])
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= WORDS:
            out.append(np.unique(rolled[a : b - WORDS + 1]))
        else:  # fewer words: one shingle of all of them
            few = np.full(min(1, b - a), b - a, np.uint64)
            for w in h[a:b]:
                few = _mix(few * _ODD + w)
            out.append(few)
    return out


def _digest(s: np.ndarray) -> bytes:
    return blake2b(s.tobytes(), digest_size=16).digest()


def _sign(batches):
    for batch in batches:
        sets = shingle_sets(batch.column("text"))
        n = [len(s) for s in sets]
        window = [s[: window_length(len(s))].tobytes() for s in sets]
        digest = list(map(_digest, sets))
        arrays = [pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(_class_key(digest)), pa.array(window, pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", "n_shingles", "digest", "key", "window"])


def _sets(batches):
    for batch in batches:
        sets = shingle_sets(batch.column("text"))
        arrays = [pa.array(map(_digest, sets), pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, ["digest", "shingles"])


def _class_key(digests: list[bytes]) -> np.ndarray:
    """A positive number of each class: it only counts who meets whom."""
    return (np.frombuffer(b"".join(d[:8] for d in digests), np.int64) >> 1 & ((1 << 62) - 1)) + 1


def _cut(s: np.ndarray, buckets: int) -> np.ndarray:
    """Where the sorted shingles' ranges begin and end, one for each bucket."""
    edges = [(b << 64) // buckets for b in range(1, buckets)]
    return np.concatenate([[0], np.searchsorted(s, np.array(edges, np.uint64)), [len(s)]])


def _runs(s: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)


def _meet(buckets: int):
    """Windows of a batch, by bucket: a shingle of one class goes with that class, one of several classes goes once, as each of
    them has met another already; those meetings are rows without shingles."""

    def run(batches):
        for turn, batch in enumerate(batches):
            windows = [np.frombuffer(w, np.uint64) for w in batch.column("window").to_pylist()]
            if not sum(map(len, windows)):
                continue
            key = np.repeat(batch.column("key").to_numpy(), [len(w) for w in windows])
            s = np.concatenate(windows)
            order = np.lexsort((key, s))
            s, key = s[order], key[order]
            new = np.concatenate([[True], (s[1:] != s[:-1]) | (key[1:] != key[:-1])])
            s, key = s[new], key[new]
            at = _runs(s)
            size = np.diff(np.append(at, len(s)))
            met = np.repeat(size > 1, size)
            once, owner = s[at], np.where(size > 1, 0, key[at])
            cut = _cut(once, buckets)
            full = np.flatnonzero(np.diff(cut))
            rows = [(int(b), once[cut[b] : cut[b + 1]].tobytes(), owner[cut[b] : cut[b + 1]].tobytes()) for b in full]
            if met.any():
                rows.append((turn % buckets, None, key[met].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], ["bucket", "s", "key"])

    return run


def _meetings(table: pa.Table) -> pa.Table:
    """key, met: how often each class met another in this bucket."""
    whole = [(np.frombuffer(s, np.uint64), np.frombuffer(k, np.int64)) for s, k in zip(table.column("s").to_pylist(), table.column("key").to_pylist()) if s is not None]
    done = [np.frombuffer(k, np.int64) for s, k in zip(table.column("s").to_pylist(), table.column("key").to_pylist()) if s is None]
    if whole:
        s, key = (np.concatenate(x) for x in zip(*whole))
        order = np.lexsort((key, s))
        s, key = s[order], key[order]
        at = _runs(s)
        size = np.diff(np.append(at, len(s)))
        several = np.repeat(key[at] != key[at + size - 1], size)
        new = np.concatenate([[True], (s[1:] != s[:-1]) | (key[1:] != key[:-1])])
        done.append(key[several & new & (key > 0)])
    key, met = np.unique(np.concatenate(done), return_counts=True)
    return pa.table({"key": pa.array(key, pa.int64()), "met": pa.array(met, pa.int64())})


def _count(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        """A block's shingles and in how many of its sets they are, by bucket."""
        block = table.column("block")[0].as_py()
        s, n = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]), return_counts=True)
        cut = _cut(s, buckets)
        rows = [(int(b), block, s[cut[b] : cut[b + 1]].tobytes(), n[cut[b] : cut[b + 1]].astype(np.int64).tobytes()) for b in np.flatnonzero(np.diff(cut))]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["bucket", "block", "s", "n"])

    return run


PACKED = "bucket int, block int, s binary, n binary"


def _total(table: pa.Table) -> pa.Table:
    """What each block must know of this bucket: its shingles that are in two sets or more, and in how many."""
    s = [np.frombuffer(x, np.uint64) for x in table.column("s").to_pylist()]
    n = [np.frombuffer(x, np.int64) for x in table.column("n").to_pylist()]
    block = table.column("block").to_pylist()
    every, place = np.unique(np.concatenate(s), return_inverse=True)
    total = np.bincount(place, np.concatenate(n)).astype(np.int64)
    rows, at = [], 0
    for b, own in zip(block, s):
        t = total[place[at : at + len(own)]]
        at += len(own)
        if (t > 1).any():
            rows.append((b, own[t > 1].tobytes(), t[t > 1].tobytes()))
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], names=["block", "s", "n"])


def _short_lists(sets: pa.Table, counts: pa.Table) -> pa.Table:
    """class, n, shorts: the shortest lists of each set that has enough shared shingles, as many as may be missing and one."""
    out: dict[str, list] = {"class": [], "n": [], "shorts": []}
    if len(counts) and len(sets):
        s = np.concatenate([np.frombuffer(x, np.uint64) for x in counts.column("s").to_pylist()])
        n = np.concatenate([np.frombuffer(x, np.int64) for x in counts.column("n").to_pylist()])
        order = np.argsort(s)
        s, n = s[order], n[order]
        for one, raw in zip(sets.column("class").to_pylist(), sets.column("shingles").to_pylist()):
            own = np.frombuffer(raw, np.uint64)
            at = np.minimum(np.searchsorted(s, own), len(s) - 1)
            shared = s[at] == own
            spare = int(shared.sum()) - least_overlap(len(own)) + 1
            if spare > 0:
                own, df = own[shared], n[at[shared]]
                out["class"].append(one)
                out["n"].append(len(raw) // 8)
                out["shorts"].append(own[np.lexsort((own, df))][:spare].view(np.int64))
    return pa.table([pa.array(out["class"], pa.int64()), pa.array(out["n"], pa.int64()), pa.array(out["shorts"], pa.list_(pa.int64()))], names=["class", "n", "shorts"])


def _confirm(batches):
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist()):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            keep.append(len(np.intersect1d(x, y, assume_unique=True)) >= required(len(x), len(y)))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def merge_skip(lists: list[list[int]], least: int) -> dict[int, int]:
    """Values that are in ``least`` of the sorted lists or more, with their counts: a heap of the lists' heads; when too few
    heads agree, the smallest are taken off and their lists skip ahead to the next head that could."""
    heads = [(x[0], i, 0) for i, x in enumerate(lists) if x]
    heapq.heapify(heads)
    found = {}
    while len(heads) >= least:
        value, taken = heads[0][0], []
        while heads and heads[0][0] == value:
            taken.append(heapq.heappop(heads))
        if len(taken) >= least:
            found[value] = len(taken)
            to = value + 1
        else:
            while heads and len(taken) < least - 1:
                taken.append(heapq.heappop(heads))
            if not heads:
                break
            to = heads[0][0] if least > 1 else value + 1
        for _, i, at in taken:
            x = lists[i]
            at = bisect_left(x, to, at)
            if at < len(x):
                heapq.heappush(heads, (x[at], i, at))
    return found


def long_lists(t: int, longest: int) -> int:
    """How many of the longest lists are probed and not merged: fewer than t, so that a partner is in a merged one."""
    return max(0, min(t - 1, int(t / (MU * math.log2(max(2, longest)) + 1))))


def divide_skip(ids: np.ndarray, label: np.ndarray, block: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that join the components of these sets, each found by a query for the sets no smaller than it. Lists hold
    places in the order of size, so that a query's lists begin after its own entry. Who is in its component already is
    no candidate; with two blocks, only members of the other one are."""
    order = np.lexsort((ids, [len(s) for s in sets]))
    ids, label, block, sets = ids[order], np.unique(label[order], return_inverse=True)[1], block[order], [sets[i] for i in order]
    n = np.array([len(s) for s in sets])
    two = block.min() != block.max()
    flat, place = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    by = np.lexsort((place, flat))
    entry = np.empty(len(flat), np.int64)  # of each set's shingles, where its entry is in the lists
    entry[by] = np.arange(len(flat))
    lists, begin = place[by], _runs(flat[by])
    run = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(flat))))
    end = np.append(begin[1:], len(flat))[run]
    probe = run * len(sets) + lists  # sorted: a binary search finds whether a place is in a list
    largest = np.searchsorted(n, 5 * n // 4, "right")
    starts = np.cumsum(n) - n
    links = []
    for q in range(len(sets)):
        own = entry[starts[q] : starts[q] + n[q]]
        tails = end[own] - own - 1
        own, tails = own[tails > 0], tails[tails > 0]
        t = int(required(n[q], n[q]))
        if len(own) < t:
            continue
        own, tails = own[np.argsort(tails, kind="stable")], np.sort(tails)
        long = long_lists(t, int(tails[-1]))
        short = own[: len(own) - long]
        merge = []
        for at in short.tolist():
            x = lists[at + 1 : end[at]]
            x = x[(label[x] != label[q]) & (x < largest[q])]
            merge.append((x[block[x] != block[q]] if two else x).tolist())
        for c, count in merge_skip(merge, t - long).items():
            if label[c] == label[q]:
                continue  # since it was merged
            if long:
                want = run[own[len(own) - long :]] * len(sets) + c
                count += int((probe[np.minimum(np.searchsorted(probe, want), len(probe) - 1)] == want).sum())
            if count >= required(n[q], n[c]):
                links.append((int(ids[q]), int(ids[c])))
                label[label == label[c]] = label[q]
    return links


def _search(table: pa.Table) -> pa.Table:
    ids, label, block = (table.column(c).to_numpy() for c in ("class", "label", "block"))
    links = divide_skip(ids, label, block, [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()])
    return pa.table([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"])


PAIR = "a long, b long"


def _active(scratch: Scratch, signed: DataFrame, classes: DataFrame, total: int) -> DataFrame:
    """Classes whose windows meet others often enough."""
    buckets = groups_for(total * 3 // 10, BUCKET)
    sent = signed.where("n_shingles > 0").select("key", "window").mapInArrow(_meet(buckets), "bucket int, s binary, key binary")
    met = sent.groupBy("bucket").applyInArrow(_meetings, "key long, met long").groupBy("key").agg(F.sum("met").alias("met"))
    return scratch.put(classes.join(met, "key").where("met >= n * 2 div 25 + 1").select("class", "digest", "doc_id", "n"), "active")


def _whole_sets(scratch: Scratch, text: DataFrame, active: DataFrame) -> DataFrame:
    """class, n, shingles of the active classes."""
    ids = scratch.put(active.select(F.col("doc_id").alias("_id")).distinct(), "active-ids")
    few = ids.count() <= BROADCAST_IDS
    chosen = text.join(F.broadcast(ids) if few else ids, text["doc_id"] == ids["_id"], "left_semi").select("text")
    sets = chosen.mapInArrow(_sets, "digest binary, shingles binary")
    return scratch.put(sets.join(active, "digest").dropDuplicates(["class"]).select("class", "n", "shingles"), "sets")


def _ranked(scratch: Scratch, sets: DataFrame) -> DataFrame:
    """class, s: the short lists of every set that has enough shared shingles."""
    total = sets.agg(F.sum("n").alias("n")).first()["n"] or 0
    parts = groups_for(total, BUCKET)
    blocked = sets.withColumn("block", hash_group(parts, "class"))
    counted = blocked.groupBy("block").applyInArrow(_count(parts), PACKED).groupBy("bucket").applyInArrow(_total, "block int, s binary, n binary")
    short = blocked.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(_short_lists, "class long, n long, shorts array<long>")
    return scratch.put(short.select("class", "n", F.explode("shorts").alias("s")), "short")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    left, right = (sets.select("class", "shingles").toDF(*names) for names in (("a", "sa"), ("b", "sb")))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(_confirm, PAIR)


def _families(scratch: Scratch, short: DataFrame, links: DataFrame) -> DataFrame | None:
    """class, label (its component so far), family: of the sets that share a short list with another component."""
    labels = connected_components(scratch.spark, links).toDF("class", "label")
    labelled = scratch.put(short.join(labels, "class", "left").select("class", "s", F.coalesce("label", "class").alias("label")), "labelled")
    mixed = labelled.groupBy("s").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("class").alias("first")).where("lo <> hi").select("s", "first")
    open_ = scratch.put(labelled.join(mixed, "s").select("class", "label", "first"), "open")
    if open_.isEmpty():
        return None
    family = connected_components(scratch.spark, open_.select(F.col("first").alias("a"), F.col("class").alias("b"))).toDF("class", "family")
    return scratch.put(open_.select("class", "label").distinct().join(family, "class"), "families")


def _searched(scratch: Scratch, families: DataFrame, sets: DataFrame) -> DataFrame:
    """Small families are dealt into tasks whole, the others by pairs of blocks."""
    members = families.join(sets, "class")
    size = families.join(sets.select("class", "n"), "class").groupBy("family").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("shingles"))
    size = size.withColumn("blocks", F.greatest(F.ceil(F.col("members") / BLOCK_SETS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int"))
    size = scratch.put(size, "family-sizes")
    rows = members.join(size.select("family", "blocks"), "family").withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    tasks = groups_for(size.agg(F.sum("shingles")).first()[0], BLOCK_SHINGLES)
    keep = ["deal", "lo", "hi", "block", "class", "label", "shingles"]
    small = rows.where("blocks = 1").select(hash_group(tasks, "family").cast("long").alias("deal"), F.lit(0).alias("lo"), F.lit(0).alias("hi"), *keep[3:])
    found = small.groupBy("deal", "lo", "hi").applyInArrow(_search, PAIR)
    if not size.where("blocks > 1").isEmpty():
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        large = rows.where("blocks > 1").withColumn("other", other).withColumns({"deal": F.col("family"), "lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
        found = found.unionAll(large.select(*keep).groupBy("deal", "lo", "hi").applyInArrow(_search, PAIR))
    return scratch.put(found, "found")


def ngram_join(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest id of the documents reached by links, itself included.

    Ids are integers. A null or empty text, or one of white space, has no shingles and is linked with nothing. Each row
    is a document: an id that repeats with other texts has each linked by itself, and rows that repeat both share a result.
    A row without an id is linked with nothing and has a null component. Other columns are ignored; an empty table gives
    an empty result.
    """
    small_batches(spark)
    scratch = Scratch(spark, "ngram-join")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    signed = text.mapInArrow(_sign, "doc_id long, n_shingles long, digest binary, key long, window binary").withColumn("row", F.monotonically_increasing_id())
    signed = scratch.put(signed, "signed")
    usable = signed.where("n_shingles > 0 and doc_id is not null")
    classes = usable.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.min("row").alias("class"), F.min("n_shingles").alias("n"), F.min("key").alias("key"))
    classes = scratch.put(classes, "classes")
    total = usable.agg(F.sum("n_shingles").alias("n")).first()["n"] or 0

    sets = _whole_sets(scratch, text, _active(scratch, usable, classes, total))
    short = _ranked(scratch, sets)
    lists = short.groupBy("s").agg(F.min("class").alias("first"), F.count(F.lit(1)).alias("size")).where("size > 1")
    to = F.struct("size", "first")
    ends = short.select("class", "s").join(lists, "s").groupBy("class").agg(F.min(to).alias("short"), F.max(to).alias("long"))
    stars = ends.select(F.explode(F.array("short.first", "long.first")).alias("a"), F.col("class").alias("b")).where("a <> b").distinct()
    links = scratch.put(_confirmed(stars, sets), "star-links")
    families = _families(scratch, short, links)
    if families is not None:
        links = links.unionAll(_searched(scratch, families, sets))

    found = connected_components(spark, links).toDF("class", "component")
    least = classes.join(found, "class").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    linked = found.join(least, "component").select("class", "component_id")
    of_class = classes.select("class", "digest", "doc_id").join(linked, "class", "left").select("digest", F.coalesce("component_id", "doc_id").alias("component_id"))
    of_class = scratch.put(of_class, "of-class")
    rows = signed.select("doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("digest")).alias("digest"))
    out = rows.where("digest is not null").join(of_class, "digest").select("doc_id", "n_shingles", "component_id")
    return out.unionAll(rows.where("digest is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(spark, documents(spark, sf_dir))


QUERIES = {"op11_ngram_join": op11_ngram_join}
ORACLE_SQL: dict[str, str] = {}
