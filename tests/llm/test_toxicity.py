"""The classifier: held-out accuracy, the counterfactual penalty, inputs that mustn't matter, odd rows."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from windlake.llm import toxicity as T


@pytest.fixture(scope="module")
def made(spark):
    rnd = random.Random(11)
    words = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(400)]
    rows, labels = [], []
    for i in range(3000):
        toxic = i % 5 == 0
        text = [rnd.choice(words) for _ in range(40)] + (["idiot", "scum"] if toxic else [])
        if i % 3 == 0:  # one group is named mostly in toxic texts, which must not make it toxic
            text.append("muslims" if toxic or rnd.random() < 0.1 else "buddhists")
        rnd.shuffle(text)
        rows.append((i, " ".join(text), "en", "s", 1))
        labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string, f int").repartition(8)
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark, made):
    docs, labels = made
    got = T.score(spark, docs, T.fit(spark, docs, labels)).join(labels, "doc_id").collect()
    assert len(got) == 3000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.predicted == r.toxic for r in held]) > 0.98
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in got)


def test_swaps_change_less_with_the_penalty(spark, made):
    def rows(texts):
        vec = T.Vectoriser({f: i for i, f in enumerate(index)})
        counts = [T.word_counts(t) for t in texts]
        xs = [vec(c) for c in counts]
        ds = [d for x, c in zip(xs, counts) if (d := T.score_change(vec, x, c))]
        flat = lambda r: T.Rows(np.array([len(x) for x in r]), np.array([f for x in r for f in x]), np.array([v for x in r for v in x.values()]), len(index))
        return flat(xs), flat(ds)

    docs, labels = made
    got = docs.join(labels, "doc_id").select("text", "toxic").limit(800).collect()
    index = sorted({f for r in got for w in T.word_counts(r.text) for f in T.features_of(w)})
    x, d = rows([r.text for r in got])
    y = np.array([float(r.toxic) for r in got])
    none = T.Rows(np.zeros(0, int), np.zeros(0), np.zeros(0), x.width)
    part = T.Part(x, y, d, none, np.zeros(0))
    weigh = 1 / len(y)
    weights = {f: T.learn(lambda th, f=f: T.loss_and_slope(part, th, (weigh, weigh), d.n, f), x.width)[0] for f in (0.0, 1.0)}
    change = {f: np.abs(d.dot(w)).mean() for f, w in weights.items()}
    assert change[1.0] < 0.5 * change[0.0]


def test_swaps_stay_in_a_language_and_are_averaged():
    assert "women" not in T.PARTNERS["frauen"] and set(T.PARTNERS["femmes"]) == {"hommes", "filles", "garçons"}
    got = T.swaps(T.word_counts("old citizens and citizens"))
    assert len(got) == 3 + 3 and all(c.total() == 4 for c in got) and T.swaps(T.word_counts("nobody")) == []


def false_positives(spark, docs, labels, fairness):
    """Of clean held-out texts with a neutral mention added, those that are called toxic after training on toxic texts that
    name one group far more often than clean ones do; and those called so without the mention."""
    toxic = F.col("toxic") == 1
    named = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(100)) < F.when(toxic, 70).otherwise(2)
    train = docs.join(labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id")
    seen = train.where(~T.held_out()).withColumn("text", F.when(named, F.concat("text", F.lit(" muslims"))).otherwise(F.col("text")))
    model = T.fit(spark, seen.select("doc_id", "text"), labels, fairness=fairness)
    clean = train.where(T.held_out() & ~toxic)
    mention = clean.withColumn("text", F.concat("text", F.lit(" the muslims of our street")))
    count = lambda d: T.score(spark, d, model).where("predicted = 1").count()
    return count(mention), count(clean), clean.count()


def test_fewer_false_positives_on_neutral_mentions(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    (plain, base, n), (fair, fair_base, _) = (false_positives(spark, docs, labels, f) for f in (0.0, T.FAIRNESS))
    print("false positives with a neutral mention, without one, of clean texts:", (plain, base), (fair, fair_base), n)
    assert fair <= 0.5 * plain and fair <= fair_base + 0.02 * n


def test_only_the_text_counts(spark, made):
    docs, labels = made
    model = T.fit(spark, docs, labels)
    other = docs.selectExpr("doc_id + 1000000 as doc_id", "text", "'xx' as lang", "'idiot' as score", "9 as f")
    a, b = ({r.doc_id % 1_000_000: r.score for r in T.score(spark, d, model).collect()} for d in (docs, other))
    assert a == b


def test_odd_rows(spark, made):
    docs, labels = made
    model = T.fit(spark, docs, labels)
    odd = spark.createDataFrame([(1, None, 2.0), (2, "", 2.0), (None, "idiot scum", 2.0), (1, None, 2.0), (3, "idiot scum " * 50_000, 2.0)], "doc_id long, text string, predicted double")
    got = T.score(spark, odd, model).collect()
    assert len(got) == 5 and {r.score for r in got if r.doc_id in (1, 2)} == {model.score("")} and sum(r.predicted for r in got) == 2
    assert T.score(spark, odd.limit(0), model).count() == 0
    none = T.fit(spark, docs, labels.limit(0))
    assert none.score("idiot") < 0.3


def test_slope_is_the_losss(made):
    rng = np.random.default_rng(1)
    some = lambda n: T.Rows(np.full(n, 4), rng.integers(0, 9, 4 * n), rng.normal(size=4 * n), 9)
    part = T.Part(some(30), (rng.random(30) < 0.3).astype(float), some(8), some(1), np.zeros(1))
    theta = rng.normal(size=10)
    f = lambda th: T.loss_and_slope(part, th, (0.5, 2.0), 8, 1.5)
    for i in range(10):
        e = np.eye(10)[i] * 1e-3
        assert f(theta)[1 + i] == pytest.approx((f(theta + e)[0] - f(theta - e)[0]) / 2e-3, rel=0.02, abs=2e-3)


def test_an_id_that_repeats_is_learnt_from_once_a_text(spark, made):
    """One labelled id on most of the rows, and one with many texts: what is learnt from stays bounded."""
    docs, labels = made
    first = docs.where(~T.held_out()).limit(1).first()
    copies = spark.range(20_000).select(F.lit(first.doc_id).alias("doc_id"), F.lit(first.text).alias("text"))
    texts = spark.range(3_000).select(F.lit(first.doc_id).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    crowd = docs.select("doc_id", "text").unionAll(copies).unionAll(texts)
    scratch = T.Scratch(spark, "test-toxicity")
    rows = T._labelled(scratch, crowd, labels, 1_000)
    assert rows.count() == 1_000 and rows.where(F.col("text") == first.text).count() <= 1
    alike = T.fit(spark, docs.unionByName(docs), labels)
    once = T.fit(spark, docs, labels)
    texts = [r.text for r in docs.limit(200).collect()]
    assert np.allclose([alike.score(t) for t in texts], [once.score(t) for t in texts], atol=1e-3)
