"""Near-duplicates by b-bit MinHash: bands find candidates, packed low bits estimate, full shingle sets confirm.

Texts with equal shingle sets are one class, so copies never meet each other in a bucket. Candidates are confirmed in
three steps. First each class is held against one centre of each of its buckets, then against its likeliest partner in
another component, among some thousands of its bucket, both at linear cost, which joins dense groups. Then all pairs
across components are compared by their packed bits and by bitmaps of their shingles, which bound what two texts can
share, inside the tasks; only pairs that neither can rule out are confirmed on full sets. A bucket too large for one task
doesn't send its members round: they are split by finer keys. Two sets at the least similarity share one of the rarest
shingles of each (as many as may be missing, and one), so its members' rare shingles take the bucket's place: exact, and
what makes the bucket large, a passage that all of its texts have, is no rare shingle of any.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from windlake.llm.common import BROADCAST_IDS, Scratch, documents, kept_in_stage, small_batches, text_or_empty
from windlake.llm.tokens import UnitHashes
from windlake.operators.components import connected_components

WORDS = 5
PERCENT = 75
BANDS, ROWS = 40, 4  # a pair at 0.75 shares no band with probability 2e-7
K = BANDS * ROWS
BITS = 4
LANES = 64 // BITS
LONGS = K // LANES
STAR_BANDS = 10  # bands of the first step; the second uses all
LEAST_ESTIMATE = 0.56  # over five standard deviations of the estimate below 0.75
BLOCK = 4096  # members of a bucket or key that one task compares
MAP_BITS = 2048

#: Disagreeing lanes above which a pair's collision-corrected estimate is under LEAST_ESTIMATE: equal low bits also come
#: by chance, at 2**-BITS.
MOST_UNEQUAL = int(K * (1 - LEAST_ESTIMATE) * (1 - 2.0**-BITS))

_RNG = np.random.default_rng(8)
_MUL = _RNG.integers(0, 1 << 63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _RNG.integers(0, 1 << 63, K, dtype=np.uint64)
_BAND_MUL = _RNG.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND_ADD = _RNG.integers(0, 1 << 63, BANDS, dtype=np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: The six ASCII white-space characters, and lower case for A-Z.
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)


def _word_hashes(text: str) -> np.ndarray:
    """64 bits for each word, mixed from two polynomial hashes of its lower-cased bytes."""
    raw = _LOWER[np.frombuffer(text.encode(), np.uint8)]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], _SPACE[raw], [True]])))
    if not len(edge):
        return np.zeros(0, np.uint64)
    first, second = kept_in_stage("words", UnitHashes)(raw, edge[::2], edge[1::2])
    return _mix(_mix(first) * _ODD + second)


def shingle_set(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles; A-Z lower-cased; a shorter text is one shingle."""
    h = _word_hashes(text)
    if not len(h):
        return h
    n = max(1, len(h) - WORDS + 1)
    out = np.full(n, min(len(h), WORDS), np.uint64)
    for i in range(min(len(h), WORDS)):
        out = _mix(out * _ODD + h[i : i + n])
    return np.unique(out)


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    """K minima; long sets in steps, so the product stays small."""
    least = np.full(K, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        part = shingles[at : at + 2048]
        np.minimum(least, ((part[None, :] ^ _XOR[:, None]) * _MUL[:, None]).min(axis=1), out=least)
    return least


def band_keys(minima: np.ndarray) -> np.ndarray:
    return _mix((minima.reshape(BANDS, ROWS) * _BAND_MUL).sum(axis=1, dtype=np.uint64) + _BAND_ADD).view(np.int64)


def packed_bits(minima: np.ndarray) -> np.ndarray:
    """The low bits (of a mixed minimum), LANES to a long."""
    low = (_mix(minima) & np.uint64((1 << BITS) - 1)).reshape(LONGS, LANES)
    return (low << (np.arange(LANES, dtype=np.uint64) * np.uint64(BITS))).sum(axis=1, dtype=np.uint64).view(np.int64)


def _digest(data: bytes) -> bytes:
    return blake2b(data, digest_size=16).digest()


def _sign(batches):
    for batch in batches:
        n, digest, bands, bits = [], [], [], []
        for text in batch.column("text").to_pylist():
            s = shingle_set(text)
            n.append(len(s))
            digest.append(_digest(s.tobytes()))
            least = min_hashes(s) if len(s) else None
            bands.append(band_keys(least).tolist() if len(s) else None)
            bits.append(packed_bits(least).tolist() if len(s) else None)
        arrays = [pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", "n_shingles", "digest", "bands", "bits"])


def bitmap(shingles: np.ndarray) -> bytes:
    """Which of MAP_BITS places the shingles fall on."""
    on = np.zeros(MAP_BITS, bool)
    on[(shingles >> np.uint64(20)) % np.uint64(MAP_BITS)] = True
    return np.packbits(on).tobytes()


def _sets(batches):
    for batch in batches:
        sets = [shingle_set(t) for t in batch.column("text").to_pylist()]
        raw = [s.tobytes() for s in sets]
        arrays = [pa.array(x, pa.binary()) for x in ([_digest(r) for r in raw], raw, map(bitmap, sets))]
        yield pa.RecordBatch.from_arrays([batch.column("id"), *arrays, pa.array(map(len, sets), pa.int64())], ["id", "digest", "shingles", "map", "size"])


def _confirm(batches):
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist()):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= PERCENT * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def unequal_lanes(x: Column, y: Column) -> Column:
    """How many of the K lanes of two packed signatures differ."""

    def lanes(p: Column, q: Column) -> Column:
        d = p.bitwiseXOR(q)
        for step in (BITS // 2, BITS // 4):
            d = d.bitwiseOR(F.shiftrightunsigned(d, step))
        return F.bit_count(d.bitwiseAND(F.lit(0x1111111111111111))).cast("int")

    return F.aggregate(F.zip_with(x, y, lanes), F.lit(0), lambda s, v: s + v)


_LOW = np.uint64(0x1111111111111111)


def _compare(best_only: bool):
    def run(table: pa.Table) -> pa.Table:
        """Pairs of one block, or of two, in different components, not ruled out by their bits, nor by their bitmaps: each
        place that only one text falls on is a shingle that the other lacks, which bounds what they share."""
        block, ids, label, size = (table.column(c).to_numpy() for c in ("block", "id", "label", "size"))
        maps = np.frombuffer(b"".join(table.column("map").to_pylist()), np.uint64).reshape(len(ids), -1)
        bits = table.column("bits").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(ids), -1)
        first, second = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
        same = block.min() == block.max()
        found: list[np.ndarray] = [np.zeros((3, 0), np.int64)]
        for at in range(0, len(first), 128):
            rows = first[at : at + 128]
            unequal = np.zeros((len(rows), len(second)), np.uint16)
            for k in range(LONGS):
                d = bits[rows, k][:, None] ^ bits[second, k][None, :]
                d |= d >> np.uint64(2)
                d |= d >> np.uint64(1)
                unequal += np.bitwise_count(d & _LOW)
            near = (unequal <= MOST_UNEQUAL) & (label[rows][:, None] != label[second][None, :])
            if same:
                near &= rows[:, None] < second[None, :]
            i, j = np.nonzero(near)
            score, i, j = unequal[i, j].astype(np.int64), rows[i], second[j]
            for part in range(0, len(i), 20_000):
                x, y = i[part : part + 20_000], j[part : part + 20_000]
                only_x, only_y = (np.bitwise_count(maps[p] & ~maps[q]).sum(axis=1, dtype=np.int64) for p, q in ((x, y), (y, x)))
                shared = np.minimum(size[x] - only_x, size[y] - only_y)
                ok = 100 * shared >= PERCENT * (size[x] + size[y] - shared)
                found.append(np.stack([x[ok], y[ok], score[part : part + 20_000][ok]]))
            if best_only and len(found) > 64:
                found = [_likeliest(np.concatenate(found, axis=1))]
        pairs = np.concatenate(found, axis=1)
        x, y, _ = _likeliest(pairs) if best_only else pairs
        a, b = ids[x], ids[y]
        return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})

    return run


def _likeliest(pairs: np.ndarray) -> np.ndarray:
    """Of pairs (x, y, score), those that are the best of x or of y."""
    order = np.argsort(pairs[2], kind="stable")
    keep = np.unique(np.concatenate([order[np.unique(e[order], return_index=True)[1]] for e in pairs[:2]]))
    return pairs[:, keep]


def _labelled(scratch: Scratch, members: DataFrame, links: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """The buckets' members with their component so far, and the buckets that hold several components."""
    labels = connected_components(scratch.spark, links).select(F.col("vertex").alias("id"), F.col("component").alias("label"))
    labelled = members.join(labels, "id", "left").select("id", "key", "n", F.coalesce("label", "id").alias("label"))
    labelled = scratch.put(labelled, f"{name}-labelled")
    return labelled, scratch.put(_mixed(labelled), f"{name}-mixed")


def _mixed(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")


PAIR = "a long, b long"


def _likely(scratch: Scratch, members: DataFrame, profiles: DataFrame, links: DataFrame) -> DataFrame:
    """Each member's likeliest partner in another component, in each of its mixed buckets, or in its part of a large one."""
    labelled, mixed = _labelled(scratch, members.where(F.col("band") < STAR_BANDS), links, "best")
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / BLOCK)).alias("part")
    rows = labelled.join(mixed, "key").select("key", "id", "label", part).join(profiles, "id").withColumn("block", F.lit(0))
    return scratch.put(rows.groupBy("key", "part").applyInArrow(_compare(True), PAIR).distinct(), "best")


def _across(scratch: Scratch, members: DataFrame, profiles: DataFrame, sets: DataFrame, links: DataFrame) -> DataFrame:
    """All candidate pairs across the components that the links so far make."""
    labelled, mixed = _labelled(scratch, members, links, "rest")
    open_ = labelled.join(mixed, "key")
    small = open_.where(F.col("n") <= BLOCK).select("key", "id", "label")
    large = scratch.put(open_.where(F.col("n") > BLOCK).select("id", "label").distinct(), "rest-large")
    found = small.join(profiles, "id").withColumn("block", F.lit(0)).groupBy("key").applyInArrow(_compare(False), PAIR)
    if not large.isEmpty():
        found = found.unionAll(_by_rare_shingles(scratch, large, profiles, sets))
    return scratch.put(found.distinct(), "rest")


def rare_shingles(sets: DataFrame) -> DataFrame:
    """(id, key) for each of the rarest shingles of a set (id, digest, shingles array<long>): one more than it may lack of another
    set at the least similarity, in an order that all sets share. Two sets so near share one of them: if not, the one
    whose last listed shingle comes first in that order would lack too many of its own."""
    each = sets.select("id", "digest", F.explode("shingles").alias("s"))
    df = each.groupBy("s").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    ranked = each.join(df, "s", "left").groupBy("id", "digest").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(1)).alias("df"), "s"))).alias("all"))
    lack = F.size("all") - F.ceil(F.size("all") * PERCENT / 100).cast("int") + 1
    return ranked.select("id", F.explode(F.slice("all", F.lit(1), lack)).alias("r")).where("r.df > 1").select("id", F.col("r.s").alias("key")).distinct()


def _by_rare_shingles(scratch: Scratch, members: DataFrame, profiles: DataFrame, sets: DataFrame) -> DataFrame:
    """Candidate pairs of members (id, label), as they share a rare shingle."""
    chosen = sets.join(members.select("id"), "id", "left_semi").select("id", "digest", "shingles").mapInArrow(_as_longs, "id long, digest binary, shingles array<long>")
    keys = scratch.put(rare_shingles(chosen).join(members, "id"), "rare")
    several = keys.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi").select("key", "n")
    several = scratch.put(several, "rare-mixed")
    blocks = F.when(F.col("n") <= BLOCK, 1).otherwise(F.ceil(F.col("n") * 2 / BLOCK)).cast("int")
    rows = keys.join(several, "key").join(profiles, "id").withColumn("blocks", blocks)
    rows = scratch.put(rows.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")), "rare-rows")
    small = rows.where("blocks = 1").groupBy("key").applyInArrow(_compare(False), PAIR)
    # thousands of different texts with one rare shingle: pairs of blocks, the exact way that is left
    crowd = rows.where("blocks > 1")
    if crowd.isEmpty():
        return small
    spread = crowd.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
    return small.unionAll(spread.groupBy("key", "lo", "hi").applyInArrow(_compare(False), PAIR))


def _as_longs(batches):
    for batch in batches:
        lists = [np.frombuffer(x, np.int64) for x in batch.column("shingles").to_pylist()]
        ends = np.cumsum([0, *map(len, lists)])
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("digest"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *lists])))], ["id", "digest", "shingles"])


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    left, right = (sets.select("id", "shingles").toDF(*names) for names in (("a", "sa"), ("b", "sb")))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(_confirm, "a long, b long")


def near_dedup(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id of the near-duplicates it is linked with, directly or not), kept.

    Ids are integers. A null or empty text, or one of white space, has no shingles and is linked with nothing. Rows that
    repeat an id and text share a result. A row without an id is linked with nothing, has a null component and is kept.
    Other columns are ignored; an empty table gives an empty result.
    """
    small_batches(spark)
    scratch = Scratch(spark, "near-dedup")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    signed = scratch.put(text.mapInArrow(_sign, "doc_id long, n_shingles long, digest binary, bands array<long>, bits array<long>"), "signed")
    usable = signed.where("n_shingles > 0 and doc_id is not null")
    classes = usable.groupBy("digest").agg(F.min(F.struct("doc_id", "bands", "bits")).alias("c"))
    classes = scratch.put(classes.select("digest", F.col("c.doc_id").alias("id"), "c.bands", "c.bits"), "classes")
    keys = classes.select("id", F.posexplode("bands").alias("band", "key"))
    buckets = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("centre"), F.min("band").alias("band")).where("n > 1")
    buckets = scratch.put(buckets, "buckets")
    members = scratch.put(keys.select("id", "key").join(buckets, "key"), "members")

    ids = members.select("id").distinct()
    ids = scratch.put(ids, "ids")
    few = ids.count() <= BROADCAST_IDS
    chosen = text.join(F.broadcast(ids) if few else ids, text["doc_id"] == ids["id"]).select("id", "text")
    # an id with two texts has two sets: both are held against others
    sets = scratch.put(chosen.mapInArrow(_sets, "id long, digest binary, shingles binary, map binary, size long"), "sets")
    bits = classes.select("id", "bits")
    stars = members.where((F.col("id") != F.col("centre")) & (F.col("band") < STAR_BANDS)).select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct()
    near = stars.join(bits.toDF("a", "xa"), "a").join(bits.toDF("b", "xb"), "b").where(unequal_lanes(F.col("xa"), F.col("xb")) <= MOST_UNEQUAL)
    star_links = scratch.put(_confirmed(near.select("a", "b"), sets), "star-links")
    profiles = sets.select("id", "digest", "map", "size").join(classes.select("id", "digest", "bits"), ["id", "digest"]).drop("digest")
    profiles = scratch.put(profiles, "profiles")
    best = _likely(scratch, members, profiles, star_links)
    links = scratch.put(star_links.unionAll(_confirmed(best, sets)), "best-links")
    rest = _across(scratch, members, profiles, sets, links)
    links = scratch.put(links.unionAll(_confirmed(rest, sets)), "links")

    found = connected_components(spark, links)
    class_of = classes.select("digest", "id").join(found, classes["id"] == found["vertex"], "left").select("digest", F.coalesce("component", "id").alias("component"))
    class_of = scratch.put(class_of, "class-of")
    rows = signed.select("doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("digest")).alias("digest"))
    out = rows.where("digest is not null").join(class_of, "digest").select("doc_id", "n_shingles", "component")
    lone = rows.where("digest is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component"))
    return out.unionAll(lone).select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("component")).alias("kept"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(spark, documents(spark, sf_dir))


QUERIES = {"op8_near_dedup": op8_near_dedup}
ORACLE_SQL: dict[str, str] = {}
