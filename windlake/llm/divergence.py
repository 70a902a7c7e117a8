"""How far a language's sources differ in their words: term probabilities of each source held against the others'.

Terms are counted exactly, but only those that can matter are moved: a first pass makes a count-min sketch of document
frequencies by language and term, which never says less than there are, and a term it finds in too few documents is
dropped before the shuffle. The kept terms' counts stay sparse. A source gives terms that it lacks one same probability,
so a pair of sources is a base value, corrected by each source's own distinct probabilities, and by the join of the terms
that both have.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from windlake.llm.common import Scratch, documents, kept_in_stage, small_batches, text_or_empty
from windlake.llm.tokens import UnitHashes

LEAST_DOCS = 3
TOP = 200
#: The sketch: rows of cells of two bits, which stay at 3 once there. Its size is fixed (12 MB by default), whatever the input: with
#: many more terms than cells fewer are dropped early, and the exact counts still decide.
SHAPE, FULL = (3, 24), 3  # rows, and bits of a cell's number
PIECE_BITS = 16  # cells of a piece, the unit in which sketches are merged
ONE = 1_000_000_000

_LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def batch_terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct terms of a batch of texts, and for each term in it its place among them and its text's number."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    letter = _LETTER[raw]
    starts, ends = letter.copy(), letter.copy()
    starts[1:] &= ~letter[:-1]
    ends[:-1] &= ~letter[1:]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    starts[first] = letter[first]
    ends[first[1:] - 1] = letter[first[1:] - 1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    text = np.searchsorted(offsets, starts, "right") - 1
    to = np.concatenate([[0], np.cumsum(ends - starts)])
    terms = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(to.astype(np.int64)), pa.py_buffer(_LOWER[raw[letter]]))
    coded = terms.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), text


def _coded(column: pa.Array) -> tuple[list[str], np.ndarray]:
    coded = column.dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)


def _hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2], np.uint8)
    return kept_in_stage("terms", UnitHashes)(raw, offsets[:-1], offsets[1:])


def _cells(shape: tuple[int, int], langs: list[str], lang: np.ndarray, terms: pa.Array, term: np.ndarray) -> list[np.ndarray]:
    """The cell of each (language, term) in each row of the sketch."""
    one, two = _hashed(terms)
    if len(langs) > 1 or langs[0]:
        of_lang, _ = _hashed(pa.array(langs, pa.large_string()))
    else:
        of_lang = np.zeros(1, np.uint64)
    x = (one[term] ^ of_lang[lang]) * np.uint64(0x9E3779B97F4A7C15)
    y = two[term] ^ of_lang[lang]
    out = []
    for r in range(shape[0]):
        h = x + np.uint64(r) * y
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        out.append(((h ^ (h >> np.uint64(27))) >> np.uint64(64 - shape[1])).astype(np.int64))
    return out


def _document_pairs(codes: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, term) of a batch: texts and terms."""
    both = np.unique(text.astype(np.int64) * max(1, n) + codes)
    return both // max(1, n), both % max(1, n)


def add_to(cells: np.ndarray, at: np.ndarray, n: np.ndarray) -> None:
    """Adds to cells that stay at FULL. Cells that are named more than once get their sum."""
    s = np.sort(at)
    twice = s[1:][s[1:] == s[:-1]]
    if len(twice):
        again = twice[np.minimum(np.searchsorted(twice, at), len(twice) - 1)] == at
        place, back = np.unique(at[again], return_inverse=True)
        cells[place] = np.minimum(FULL, cells[place] + np.bincount(back, n[again]))
        at, n = at[~again], n[~again]
    cells[at] = np.minimum(FULL, cells[at] + n)


def _sketch(shape: tuple[int, int]):
    def run(batches):
        """One task's sketch as pieces: the numbers of its cells that aren't 0, and what they hold."""
        cells = np.zeros((shape[0], 1 << shape[1]), np.uint8)
        for batch in batches:
            terms, codes, text = batch_terms(batch.column("text"))
            if not len(codes):
                continue
            langs, lang = _coded(batch.column("lang"))
            doc, term = _document_pairs(codes, text, len(terms))
            both, n = np.unique(lang[doc] * len(terms) + term, return_counts=True)
            for row, at in zip(cells, _cells(shape, langs, both // len(terms), terms, both % len(terms))):
                add_to(row, at, n)
        flat = cells.reshape(-1)
        on = np.flatnonzero(flat)
        pieces, begin = np.unique(on >> PIECE_BITS, return_index=True)
        low = (on & ((1 << PIECE_BITS) - 1)).astype(np.uint16)
        for part in range(0, len(pieces), 64):
            some = slice(part, part + 64)
            ends = np.append(begin, len(on))[part + 1 : part + 65]
            rows = [(int(p), low[a:b].tobytes(), flat[on[a:b]].tobytes()) for p, a, b in zip(pieces[some], begin[some], ends)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], ["piece", "at", "n"])

    return run


def _merge(batches):
    """Pieces added up as they come; each leaves packed, four cells to a byte."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for piece, at, n in zip(*(batch.column(c).to_pylist() for c in ("piece", "at", "n"))):
            cells = sums.setdefault(piece, np.zeros(1 << PIECE_BITS, np.uint8))
            at = np.frombuffer(at, np.uint16)
            cells[at] = np.minimum(FULL, cells[at] + np.frombuffer(n, np.uint8))
    for piece, cells in sums.items():
        packed = (cells.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([packed.tobytes()], pa.binary())], ["piece", "cells"])


def document_frequencies(scratch: Scratch, docs: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """The merged sketch, packed: the one thing, of a fixed size, that goes by the driver."""
    pieces = docs.mapInArrow(_sketch(shape), "piece int, at binary, n binary").repartition("piece").mapInArrow(_merge, "piece int, cells binary")
    packed = np.zeros((shape[0] << shape[1] - PIECE_BITS, 1 << PIECE_BITS - 2), np.uint8)
    for r in scratch.put(pieces, "sketch").toLocalIterator():
        packed[r["piece"]] = np.frombuffer(r["cells"], np.uint8)
    return packed.reshape(shape[0], -1)


def at_least(packed: np.ndarray, cells: list[np.ndarray]) -> np.ndarray:
    """The sketch's estimate, up to FULL: never less than the documents there are."""
    read = [(row[c >> 2] >> (2 * (c & 3)).astype(np.uint8)) & FULL for row, c in zip(packed, cells)]
    return np.min(read, axis=0)


def _counts(sketch, least: int, shape: tuple[int, int]):
    def run(batches):
        for batch in batches:
            terms, codes, text = batch_terms(batch.column("text"))
            if not len(codes):
                continue
            langs, lang = _coded(batch.column("lang"))
            sources, source = _coded(batch.column("source"))
            both = np.unique(lang[text] * len(terms) + codes)
            possible = both[at_least(sketch.value, _cells(shape, langs, both // len(terms), terms, both % len(terms))) >= min(least, FULL)]
            group = lang * len(sources) + source
            every, n = np.unique(group[text] * len(terms) + codes, return_counts=True)
            doc, term = _document_pairs(codes, text, len(terms))
            _, df = np.unique(group[doc] * len(terms) + term, return_counts=True)  # the same keys in the same order
            l_at, s_at, t_at = every // len(terms) // len(sources), every // len(terms) % len(sources), every % len(terms)
            key = l_at * len(terms) + t_at
            on = possible[np.minimum(np.searchsorted(possible, key), max(0, len(possible) - 1))] == key if len(possible) else np.zeros(len(key), bool)
            columns = [pa.array(langs, pa.string()).take(pa.array(l_at[on])), pa.array(sources, pa.string()).take(pa.array(s_at[on])), terms.take(pa.array(t_at[on])).cast(pa.string()), pa.array(n[on]), pa.array(df[on])]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "df"])

    return run


def kept_terms(spark: SparkSession, scratch: Scratch, docs: DataFrame, least: int, shape: tuple[int, int]) -> DataFrame:
    """lang, source, term, n (occurrences), lang_n (in all of the language), lead (true in one row of each lang and term), of
    the terms in ``least`` of their language's documents."""
    sketch = spark.sparkContext.broadcast(document_frequencies(scratch, docs, shape))
    found = docs.mapInArrow(_counts(sketch, least, shape), "lang string, source string, term string, n long, df long")
    found = found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    of_term = Window.partitionBy("lang", "term")  # a row for each source that has it
    found = found.withColumns({"lang_df": F.sum("df").over(of_term), "lang_n": F.sum("n").over(of_term), "lead": F.col("source") == F.min("source").over(of_term)})
    return scratch.put(found.where(F.col("lang_df") >= least).select("lang", "source", "term", "n", "lang_n", "lead"), "kept")


def share(count: Column, total: Column) -> Column:
    """p = 1 + floor(10^9 (count + 1) / total), exactly."""
    return 1 + F.call_function("div", (count + 1).cast("decimal(20,0)") * F.lit(ONE).cast("decimal(10,0)"), F.nullif(total, F.lit(0)).cast("decimal(20,0)"))


def gap(p: Column | str, q: Column | str) -> Column:
    """floor((p - q)^2 / q). Both are between 1 and 10^9 + 1, so longs hold it."""
    p, q = (F.col(x) if isinstance(x, str) else x for x in (p, q))
    return F.call_function("div", (p - q) * (p - q), q)


def _ranked(rows: DataFrame, most: int | None = None) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rows = rows.withColumn("rank", F.row_number().over(order))
    return rows if most is None else rows.where(F.col("rank") <= most)


def source_divergence(spark: SparkSession, docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP, shape: tuple[int, int] = SHAPE) -> DataFrame:
    """lang, source, part, item, value, rank: ``pair`` rows say how far each source of a language is from each other one,
    ``term`` rows which terms it uses more than its language does (the ``top`` ones).

    Null texts, languages and sources are ''. Each row is a document. A group without terms has its pair rows; a language
    without kept terms has pair rows of 0. Equal values are ranked by item. Other columns are ignored; an empty table gives
    an empty result. ``shape`` is the sketch's: of 2 bits a cell, at least 16 bits for a cell's number.
    """
    small_batches(spark, rows=1000, size=4 << 20)
    scratch = Scratch(spark, "divergence")
    docs = docs.select(*(text_or_empty(c).alias(c) for c in ("text", "lang", "source")))
    kept = kept_terms(spark, scratch, docs, least, shape)

    of_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    of_lang = kept.groupBy("lang").agg(F.count_if("lead").alias("v"), F.sum("n").alias("total"))
    groups = docs.select("lang", "source").distinct().join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left")
    groups = groups.select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "v", "total")))
    groups = scratch.put(groups.withColumn("base", share(F.lit(0), F.col("n") + F.col("v"))), "groups")

    sizes = groups.select("lang", "source", "v", "total", F.col("n").alias("group_n"), "base")
    own = kept.join(sizes, ["lang", "source"])
    own = own.select("lang", "source", "term", "base", share(F.col("n"), F.col("group_n") + F.col("v")).alias("p"), share(F.col("lang_n"), F.col("total") + F.col("v")).alias("lang_p"))
    own = scratch.put(own, "shares")
    more = own.where("p > lang_p").select("lang", "source", F.col("term").alias("item"), gap("p", "lang_p").alias("value"))
    terms = _ranked(more, top).withColumn("part", F.lit("term"))

    levels = scratch.put(own.groupBy("lang", "source", "base", "p").agg(F.count(F.lit(1)).alias("m")), "levels")
    names = ("lang", "source", "item", "value")
    a, b = groups.select("lang", "source", F.col("base").alias("base_a"), "v"), groups.select("lang", F.col("source").alias("item"), F.col("base").alias("base_b"))
    other = F.col("source") != F.col("item")
    all_lack = a.join(b, "lang").where(other).select("lang", "source", "item", F.coalesce(gap("base_a", "base_b") * F.col("v"), F.lit(0)).alias("value"))
    one = levels.withColumnRenamed("base", "base_a").join(b, "lang").where(other)
    one = one.select("lang", "source", "item", (F.col("m") * (gap("p", "base_b") - gap("base_a", "base_b"))).alias("value"))
    two = levels.toDF("lang", "item", "base_b", "p", "m").join(a, "lang").where(other)
    two = two.select("lang", "source", "item", (F.col("m") * (gap("base_a", "p") - gap("base_a", "base_b"))).alias("value"))
    # a term of both was counted once as the first's alone and once as the second's: put right, for both directions at once
    x = own.select("lang", "term", F.col("source").alias("x"), F.col("base").alias("bx"), F.col("p").alias("px"))
    y = own.select("lang", "term", F.col("source").alias("y"), F.col("base").alias("by"), F.col("p").alias("py"))
    right = lambda s, t: gap(f"p{s}", f"p{t}") - gap(f"p{s}", f"b{t}") - gap(f"b{s}", f"p{t}") + gap(f"b{s}", f"b{t}")
    both = x.join(y, ["lang", "term"]).where("x < y").groupBy("lang", "x", "y").agg(F.sum(right("x", "y")).alias("xy"), F.sum(right("y", "x")).alias("yx"))
    ways = F.explode(F.array(*(F.struct(F.col(s).alias("source"), F.col(t).alias("item"), F.col(s + t).alias("value")) for s, t in ("xy", "yx"))))
    both = both.select("lang", ways.alias("w")).select("lang", "w.source", "w.item", "w.value")
    pairs = all_lack.unionAll(one.select(*names)).unionAll(two.select(*names)).unionAll(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    out = terms.unionByName(_ranked(pairs).withColumn("part", F.lit("pair")))
    return out.select("lang", "source", "part", "item", "value", "rank")


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(spark, documents(spark, sf_dir))


QUERIES = {"op12_divergence": op12_divergence}

ORACLE_SQL = {
    "op12_divergence": r"""
        with d as (select row_number() over () as rid, coalesce(lang, '') as lang, coalesce(source, '') as source, regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as ts from documents),
        x as materialized (select rid, lang, source, translate(unnest(ts), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term from d),
        k as materialized (select lang, term, count(*)::hugeint as n from x group by lang, term having count(distinct rid) >= 3),
        lv as materialized (select lang, count(*)::hugeint as v, sum(n)::hugeint as total from k group by lang),
        c as (select lang, source, term, count(*)::hugeint as n from x group by lang, source, term),
        g as materialized (select lang, source, coalesce(v, 0) as v, coalesce((select sum(c.n) from c join k using (lang, term) where c.lang = gs.lang and c.source = gs.source), 0)::hugeint as total
            from (select distinct lang, source from d) gs left join lv using (lang)),
        p as materialized (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, 1 + 1000000000::hugeint * (coalesce(c.n, 0) + 1) // (g.total + g.v) as p, 1 + 1000000000::hugeint * (k.n + 1) // (lv.total + lv.v) as q
            from g join k using (lang) join lv using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
        pr as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
        pa as (select a.lang, a.source, b.source as item, coalesce(value, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source left join pr on pr.lang = a.lang and pr.source = a.source and pr.item = b.source),
        te as (select lang, source, term as item, ((p - q) * (p - q) // q)::bigint as value from p where n > 0 and p > q),
        r as (select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item) as rank from pa
            union all select lang, source, 'term', item, value, row_number() over (partition by lang, source order by value desc, item) from te)
        select lang, source, part, item, value, rank::int as rank from r where part = 'pair' or rank <= 200"""
}
