"""The source audit against dense counting in Python, and against SQL."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from compare import assert_same

from windlake.llm import divergence as V


def dense(docs):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(low)), lang or "", source or "") for t, lang, source in docs]
    out = []
    for lang in {d[1] for d in docs}:
        df = Counter(t for ts, at, _ in docs if at == lang for t in set(ts))
        terms = sorted(t for t in df if df[t] >= 3)
        count = {s: Counter(t for ts, at, src in docs if at == lang and src == s for t in ts) for s in {d[2] for d in docs if d[1] == lang}}
        count[None] = sum(count.values(), Counter())
        p = {}
        for s, c in count.items():
            n = sum(c[t] for t in terms) + len(terms)
            p[s] = {t: 1 + 10**9 * (c[t] + 1) // n for t in terms}
        f = lambda x, y: (x - y) ** 2 // y
        for s in count.keys() - {None}:
            pair = [(sum(f(p[s][t], p[o][t]) for t in terms), o) for o in count.keys() - {None, s}]
            term = [(f(p[s][t], p[None][t]), t) for t in terms if count[s][t] and p[s][t] > p[None][t]]
            for part, rows in (("pair", pair), ("term", term)):
                rows = sorted(rows, key=lambda r: (-r[0], r[1].encode()))
                out += [(lang, s, part, item, v, i) for i, (v, item) in enumerate(rows, 1) if part == "pair" or i <= 200]
    return sorted(out)


def got(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect())


def test_same_as_sql(spark, sf):
    assert_same(V.op12_divergence(spark, sf), sf, V.ORACLE_SQL["op12_divergence"])


def made():
    rnd = random.Random(4)
    vocabulary = [f"t{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)] + ["Ünder", "über", "É", "é", "数据"]
    docs = []
    for i in range(160):
        some = rnd.sample(vocabulary, 40)
        words = [rnd.choice(some) for _ in range(rnd.randint(0, 60))]
        docs.append((rnd.choice([" ", "7", "_", "\x7f"]).join(words), rnd.choice(["en", "en", "de", None]), rnd.choice(["a", "b", "c", "Z", "é", None, ""])))
    docs += [("Same same SAME", "xx", "one"), ("same", "xx", "two"), ("same other", "xx", "two"), (None, "yy", "p"), ("lonely", "yy", "q"), ("", None, "r"), ("big " * 20000, "en", "a"), ("aZ[`{@é\x00b", "xx", "three")]
    return docs


def test_made_rows_as_dense_counting(spark):
    docs = made()
    frame = spark.createDataFrame([(*d, "z", 1.0) for d in docs], "text string, lang string, source string, term string, n double").repartition(5)
    assert got(V.source_divergence(spark, frame)) == dense(docs)
    assert V.source_divergence(spark, frame.limit(0)).count() == 0


def test_a_crowded_sketch_changes_nothing(spark):
    """With few cells nearly all terms pass the sketch; the exact counts decide."""
    docs = [(" ".join(f"{a}x{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(9000)), "en", s) for a, s in (("a", "p"), ("b", "q"), ("c", "p"))] + made()
    assert got(V.source_divergence(spark, spark.createDataFrame(docs, "text string, lang string, source string"), shape=(1, 16))) == dense(docs)


def test_sketch_never_underestimates():
    rng = np.random.default_rng(6)
    n = 20_000
    terms = pa.array([f"term{i}" for i in range(n)], pa.large_string())
    true = rng.integers(1, 6, n)
    every = np.arange(n)
    cells = V._cells(V.SHAPE, ["en"], np.zeros(n, np.int64), terms, every)
    rows = np.zeros((V.SHAPE[0], 1 << V.SHAPE[1]), np.uint8)
    for part in np.array_split(rng.permutation(np.repeat(every, true)), 7):  # seven tasks
        own = np.zeros_like(rows)
        at, count = np.unique(part, return_counts=True)
        for row, c in zip(own, V._cells(V.SHAPE, ["en"], np.zeros(len(at), np.int64), terms, at)):
            V.add_to(row, c, count)
        rows = np.minimum(V.FULL, rows + own)
    packed = (rows.reshape(V.SHAPE[0], -1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=2, dtype=np.uint8)
    said = V.at_least(packed, cells)
    assert (said >= np.minimum(true, V.FULL)).all()
    assert (said == np.minimum(true, V.FULL)).mean() > 0.999


def test_terms_of_a_batch():
    texts = ["", "Ab ab1AB_é", "x", None, "\x7f", "É-é", "tail"]
    found, codes, text = V.batch_terms(pa.array([t or "" for t in texts])[1:])
    assert [(int(d), found[int(c)].as_py()) for d, c in zip(text, codes)] == [(0, "ab"), (0, "ab"), (0, "ab"), (0, "é"), (1, "x"), (4, "É"), (4, "é"), (5, "tail")]
