"""The filter audit against the filters applied one after another, and against SQL."""

import re
from itertools import permutations

from compare import assert_same, duck_rows, spark_rows

from windlake.llm import filter_audit as A


def apply_in_order(docs, labels):
    """Every order carried out document by document."""
    smallest, marks = {}, {}
    for i, text, _ in docs:
        if i is not None:
            smallest[text or ""] = min(i, smallest.get(text or "", i))
    for i, good, toxic in labels:
        g, t = marks.get(i, (0, 0))
        marks[i] = (max(g, int(good == 1)), max(t, int(toxic == 1)))
    failing = []
    for i, text, source in docs:
        text = text or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": i is not None and smallest[text] < i,
        }
        failing.append((source or "", {f for f in fails if fails[f]}, *(marks.get(i, (0, 0)) if i is not None else (0, 0))))
    rows, removed = {}, {}
    for part in {f[0] for f in failing}:
        for order in permutations("ABCDE"):
            left = [f for f in failing if f[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                out = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                alone = sum(x[1] == {f} for x in failing if x[0] == part)
                rows[part, "".join(order), step] = [f, len(left), len(out), sum(f in x[1] for x in gone), alone, sum(x[2] for x in out), sum(x[3] for x in out)]
                removed[part, f] = removed.get((part, f), 0) + len(out)
                gone += out
    return {k: (*v, removed[k[0], v[0]]) for k, v in rows.items()}


COLUMNS = ("filter", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def got(df):
    return {(r.part, r.filter_order, r.step): tuple(r[c] for c in COLUMNS) for r in df.collect()}


def test_same_as_sql(spark, sf):
    assert_same(A.op13_filter_audit(spark, sf), sf, A.ORACLE_SQL["op13_filter_audit"])


def odd_rows():
    long = " ".join(f"w{i}" for i in range(250))
    docs = [(1, long, "a"), (2, long, "b"), (3, long.upper(), "a"), (4, "word " * 300, "a"), (5, None, "a"), (6, "", None), (7, "\t \n", ""), (8, long + " #", "a"), (9, "é" * 50 + "A", "b"), (9, "é" * 50 + "A", "b")]
    docs += [(10, "É A", "b"), (None, long, "a"), (None, "x", "c"), (1, long, "a"), (2, "other", "b"), (11, "x", "c"), (12, "word " * 199 + "Word", "a"), (13, "a\x0bb\x0cc | ", "a"), (14, "x" * 100_000 + " B" * 3000, "c")]
    labels = [(1, 1, 0), (1, 0, 1), (2, 1, 1), (5, None, 1), (8, 1, None), (99, 1, 1), (None, 1, 1), (14, 0, 1)]
    return docs, labels


def test_odd_rows_as_filters_one_after_another(spark):
    docs, labels = odd_rows()
    frame = spark.createDataFrame([(*d, "z", 1) for d in docs], "doc_id long, text string, source string, part string, n int")
    marks = spark.createDataFrame([(*m, "z") for m in labels], "doc_id long, quality int, toxic int, digest string")
    want = apply_in_order(docs, labels)
    assert got(A.filter_audit(spark, frame, marks)) == want
    assert len(want) == 600 * len({d[2] or "" for d in docs})
    assert A.filter_audit(spark, frame.limit(0), marks).count() == 0
    none = got(A.filter_audit(spark, frame, marks.limit(0)))
    assert all(none[k][5:7] == (0, 0) and none[k][:5] == want[k][:5] for k in want)


def test_laws(spark, sf):
    rows = A.op13_filter_audit(spark, sf).collect()
    total = {r.part: r.kept + r.removed for r in rows if r.step == 1}
    for part, n in total.items():
        mine = [r for r in rows if r.part == part]
        for order in {r.filter_order for r in mine}:
            steps = sorted((r for r in mine if r.filter_order == order), key=lambda r: r.step)
            assert steps[0].kept + sum(r.removed for r in steps[:1]) == n and sum(r.removed for r in steps) == n - steps[-1].kept
        assert sum({r.filter: r.shapley for r in mine}.values()) == 120 * (n - min(r.kept for r in mine))


def test_cube_has_all_parts_together(spark):
    docs, labels = odd_rows()
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = A.subset_survivors(A.flag_counts(spark, frame, marks)).collect()
    whole = {r.subset: r.n for r in rows if r.part is None}
    assert len(whole) == 32 and whole[0] == len(docs)
    for s in whole:
        assert whole[s] == sum(r.n for r in rows if r.part is not None and r.subset == s)


def test_sql_on_null_rows(spark, tmp_path):
    docs, labels = odd_rows()
    spark.createDataFrame([(*d, "en") for d in docs], "doc_id long, text string, source string, lang string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    assert spark_rows(A.op13_filter_audit(spark, str(tmp_path))) == duck_rows(str(tmp_path), A.ORACLE_SQL["op13_filter_audit"])
