"""How five quality filters interact: what each removes alone, after others, and on average over all orders.

Texts become five failure flags. Rows with equal part and flags are counted first, so the CUBE over part and flags works on
at most 32 rows a part. Of its grouping sets, a row whose selected flags are all false counts the documents that survive
that subset of the filters. A step of an order is a pair of subsets, before it and after it: joining them says what the
step keeps and removes.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from math import factorial
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from windlake.llm.common import Scratch, documents, text_or_empty

FILTERS = "ABCDE"
ALL = (1 << len(FILTERS)) - 1
LEAST_WORDS, LEAST_DISTINCT_PCT, MOST_CAPITALS_PCT = 200, 50, 2
COUNTS = ["n", "good", "toxic"]


def bit(name: str) -> int:
    return 1 << FILTERS.index(name)


def failure_flags(docs: DataFrame) -> DataFrame:
    """doc_id, part, a to d, and a digest of the text by which copies are found: narrow rows, one for each document."""
    text = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text_or_empty().alias("text"))
    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    t = text.select("doc_id", "part", "text", F.size(words).alias("words"), F.size(F.array_distinct(words)).alias("distinct"))
    capitals = F.length("text") - F.length(F.regexp_replace("text", "[A-Z]+", ""))
    return t.select(
        "doc_id",
        "part",
        (F.col("words") < LEAST_WORDS).alias("a"),
        (F.col("distinct") * 100 < F.col("words") * LEAST_DISTINCT_PCT).alias("b"),
        (capitals * 100 > F.length("text") * MOST_CAPITALS_PCT).alias("c"),
        F.col("text").rlike("[#$%&*|]").alias("d"),
        F.unhex(F.sha2("text", 256)).alias("digest"),
    )


def flag_counts(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, a to e, and how many rows have them: n, good (quality 1), toxic. ``e``: a smaller id has the same text.

    Copies are found by the join of each (text, id) with the smallest id of its text: a text of any number of rows is
    spread over tasks by their ids, and rows that repeat an id too are counted before they move.
    """
    scratch = Scratch(spark, "filter-audit")
    flags = scratch.put(failure_flags(docs), "flags")
    rows = flags.groupBy("doc_id", "digest", "part", *"abcd").agg(F.count(F.lit(1)).alias("n"))
    first = flags.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(*(F.max((F.col(c) == 1).cast("int")).alias(c) for c in ("quality", "toxic")))
    rows = rows.join(first, ["digest", "doc_id"], "left").join(marks, "doc_id", "left")
    again = F.col("doc_id").isNotNull() & F.col("first").isNull()
    marked = lambda c: F.sum(F.col("n") * F.coalesce(c, F.lit(0)))
    return scratch.put(rows.groupBy("part", *"abcd", again.alias("e")).agg(F.sum("n").alias("n"), marked("quality").alias("good"), marked("toxic").alias("toxic")), "counts")


def subset_survivors(counts: DataFrame) -> DataFrame:
    """part, subset (a bit for each filter), n, good, toxic: what passes all filters of each of the 32 subsets, zeros included.
    The rows of all parts together have a null part."""
    names = [f.lower() for f in FILTERS]
    cube = counts.cube("part", *names).agg(*(F.sum(c).alias(c) for c in COUNTS), *(F.grouping(f).alias(f"_{f}") for f in names), F.grouping("part").alias("_part"))
    passed = reduce(lambda x, y: x & y, ((F.col(f"_{f}") == 1) | ~F.col(f) for f in names))
    subset = reduce(add, ((1 - F.col(f"_{f.lower()}").cast("int")) * bit(f) for f in FILTERS))
    known = cube.where(passed).select("part", subset.alias("subset"), *COUNTS, "_part")
    parts = known.where("subset = 0").select("part", "_part", F.explode(F.sequence(F.lit(0), F.lit(ALL))).alias("subset"))
    keyed = known.select(F.col("part").alias("p"), F.col("subset").alias("s"), F.col("_part").alias("g"), *COUNTS)
    same = F.col("part").eqNullSafe(F.col("p")) & (F.col("subset") == F.col("s")) & (F.col("_part") == F.col("g"))
    return parts.join(keyed, same, "left").select("part", "subset", *(F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS))


def _steps() -> list[tuple[str, int, str, int, int]]:
    """Each order's steps: order, step, filter, the subsets before and after."""
    out = []
    for order in permutations(FILTERS):
        before = 0
        for i, f in enumerate(order):
            out.append(("".join(order), i + 1, f, before, before | bit(f)))
            before |= bit(f)
    return out


def filter_audit(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part (source), each of the 120 orders of the filters and each of its 5 steps.

    part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley. A null text is
    empty and a null source is the part ''. Each row is a document: rows that repeat an id and its text are no copies of
    each other, as no id is smaller; a row without an id is no copy and has no labels. A document is good (toxic) if any
    of its labels says so; labels of no document don't matter. Other columns are ignored; an empty table gives no rows.
    """
    scratch = Scratch(spark, "filter-survivors")
    survive = subset_survivors(flag_counts(spark, docs, labels)).where("part is not null")
    survive = scratch.put(survive, "survivors")
    steps = _steps()
    pairs = sorted({(f, before, after, factorial(bin(before).count("1")) * factorial(4 - bin(before).count("1"))) for _, _, f, before, after in steps})
    pairs = spark.createDataFrame(pairs, "filter string, before int, after int, weight int")  # 80 rows
    plan = spark.createDataFrame([s[:4] for s in steps], "filter_order string, step int, filter string, before int")  # 600 rows
    was = survive.select("part", F.col("subset").alias("before"), *(F.col(c).alias(f"was_{c}") for c in COUNTS))
    now = survive.select("part", F.col("subset").alias("after"), *COUNTS)
    step = was.join(F.broadcast(pairs), "before").join(now, ["part", "after"])
    lost = lambda c: F.col(f"was_{c}") - F.col(c)
    step = step.select("part", "filter", "before", "after", "weight", F.col("n").alias("kept"), lost("n").alias("removed"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"))
    step = scratch.put(step, "steps")
    only = lambda on: F.sum(F.when(on, F.col("removed")).otherwise(0))
    alone = step.groupBy("part", "filter").agg(
        only(F.col("before") == 0).alias("fails"), only(F.col("after") == ALL).alias("unique_fails"), F.sum(F.col("removed") * F.col("weight")).alias("shapley")
    )
    out = step.join(alone, ["part", "filter"]).join(F.broadcast(plan), ["filter", "before"])
    return out.select("part", "filter_order", "step", "filter", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(spark, documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op13_filter_audit": op13_filter_audit}

ORACLE_SQL = {
    "op13_filter_audit": r"""
        with w as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
        fl as (select doc_id, part, (len(ws) < 200)::int + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::int + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text))::int
            + 8 * regexp_matches(text, '[#$%&*|]')::int + 16 * coalesce(doc_id > min(doc_id) over (partition by text), false)::int as m from w),
        lb as (select doc_id, max((quality = 1)::int) as q, max((toxic = 1)::int) as x from labels group by doc_id),
        g as (select part, m, count(*) as n, sum(coalesce(q, 0)) as q, sum(coalesce(x, 0)) as x from fl left join lb using (doc_id) group by part, m),
        l as (select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(f, b)),
        o as (select a.f || b.f || c.f || d.f || e.f as filter_order, [a.f, b.f, c.f, d.f, e.f] as fs, [a.b, b.b, c.b, d.b, e.b] as bs from l a, l b, l c, l d, l e where a.b + b.b + c.b + d.b + e.b = 31 and (a.b | b.b | c.b | d.b | e.b) = 31),
        s as (select filter_order, i as step, fs[i] as filter, bs[i] as b, coalesce(list_sum(bs[1:i - 1]), 0)::int as before from o, range(1, 6) r(i)),
        r as (select part, filter_order, step, filter, coalesce(sum(n) filter (m & (before | b) = 0), 0) as kept, coalesce(sum(n) filter (m & before = 0 and m & b <> 0), 0) as removed,
            coalesce(sum(n) filter (m & before <> 0 and m & b <> 0), 0) as redundant, coalesce(sum(n) filter (m = b), 0) as unique_fails,
            coalesce(sum(q) filter (m & before = 0 and m & b <> 0), 0) as good_lost, coalesce(sum(x) filter (m & before = 0 and m & b <> 0), 0) as toxic_lost from g, s group by all)
        select part, filter_order, step::int as step, filter, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails, good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost,
            (sum(removed) over (partition by part, filter))::bigint as shapley from r"""
}
