"""Each stage of the pipeline against brute force on its own input."""

import re
from collections import Counter

import corpus_pipeline
from test_near_dedup import brute
from test_secret_scan import plain_spans
from test_tokens import check_packing

from windlake.llm.toxicity import op6_toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows(df):
    return Counter(tuple(r[c] for c in COLUMNS) for r in df.collect())


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [s for s, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "secret scans", "packing"]
    _, toxicity, exact, near, secrets = None, *(f for _, f in corpus_pipeline.STAGES[:4])

    def step(f, name):
        f(spark, docs, sf).write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    before = rows(docs)
    bad = {r.doc_id for r in op6_toxicity(spark, sf).where("predicted = 1").collect()}
    docs = step(toxicity, "a")
    assert docs.columns == COLUMNS and rows(docs) == Counter({r: n for r, n in before.items() if r[0] not in bad})

    before, first = rows(docs), {}
    for r in sorted(before):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1]), r[0])
    docs = step(exact, "b")
    assert docs.columns == COLUMNS and rows(docs) == Counter({r: n for r, n in before.items() if first[re.sub(r"[\x20\x09-\x0D]+", " ", r[1])] == r[0]})

    before = rows(docs)
    kept = {i for i, (_, _, k) in brute([(r[0], r[1]) for r in before]).items() if k}
    docs = step(near, "c")
    assert docs.columns == COLUMNS and rows(docs) == Counter({r: n for r, n in before.items() if r[0] in kept})

    before = {r[0]: r for r in rows(docs)}
    docs = step(secrets, "d")
    after = {r[0]: r for r in rows(docs)}
    assert docs.columns == COLUMNS and before.keys() == after.keys()
    for i, r in after.items():
        assert not plain_spans(r[1]) and r[4] == len(r[1]) and r[2:4] == before[i][2:4]
        assert (r[1] == before[i][1]) == ("[secret]" not in r[1])
    check_packing(spark, docs)


def test_run_and_odd_rows(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 100 and {"sequence_id", "offset"} <= set(out.columns)
    odd = [(1, None, "en", None, None), (1, None, "en", None, None), (2, "", None, "s", 0), (None, "a token=abcdef12", "en", "s", 3), (3, "a b", "en", "s", 3), (4, "a  b", "en", "s", 4)]
    docs = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long")
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:4]:
            frame = stage(spark, frame, sf)
            assert frame.columns == COLUMNS
        left = sorted(frame.collect(), key=repr)
        assert [r.doc_id for r in left] in ([1, 3, None], [])


def test_an_id_with_several_texts(spark, sf):
    a, b = " ".join(f"alpha{i}" for i in range(60)), " ".join(f"beta{i}" for i in range(60))
    made = [(3, b), (7, a), (7, b), (7, b), (8, "one text"), (8, "another text"), (None, b), (None, "no id"), (None, "no  id"), (9, a + " more")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in made], "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.exact(spark, docs, sf)
    assert left.columns == COLUMNS
    assert Counter((r.doc_id, r.text) for r in left.collect()) == Counter([(3, b), (7, a), (8, "one text"), (8, "another text"), (None, "no  id"), (9, a + " more")])
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in [(3, b), (7, a), (7, b + " more"), (9, a + " more"), (8, "x y z")]], docs.schema)
    left = corpus_pipeline.near(spark, docs, sf)
    assert Counter((r.doc_id, r.text) for r in left.collect()) == Counter([(3, b), (7, a), (8, "x y z")])
