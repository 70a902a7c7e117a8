"""Passage dedup against brute force over all strings of LENGTH bytes."""

import random
from collections import Counter
from hashlib import sha256

import numpy as np

from windlake.llm import passage_dedup as P

L = P.LENGTH


def brute(docs):
    data = [(i, (t or "").encode()) for i, t in docs]
    seen = Counter(d[p : p + L] for _, d in data for p in range(len(d) - L + 1))
    out = Counter()
    for i, d in data:
        gone = np.zeros(len(d) + 1, bool)
        for p in range(len(d) - L + 1):
            if seen[d[p : p + L]] > 1:
                gone[p : p + L] = True
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out[i, len(d), int(gone.sum()), int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(d) else 0, sha256(kept).hexdigest()] += 1
    return out


def got(df):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def test_on_documents(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(P.op2_passage_dedup(spark, sf)) == brute(docs)


def test_planted_passages(spark, monkeypatch):
    monkeypatch.setattr(P, "MOST_MEMBERS", 6)  # so that large collections are split
    rnd = random.Random(7)
    noise = lambda n: "".join(rnd.choice("abcdefghij klmnop") for _ in range(n))
    passage, longer = noise(430), "é" + noise(900)
    docs = [(i, noise(rnd.randint(0, 900)) + passage + noise(rnd.randint(0, 300))) for i in range(15)]
    docs += [(20 + i, noise(50) + longer[i * 30 : 930 - i * 17] + noise(20)) for i in range(9)]
    docs += [(40, passage[:L]), (41, passage[: L - 1]), (42, noise(300) + longer[100:500]), (43, passage * 3), (44, "ab" * 700), (45, "a" * 1000), (46, None), (47, ""), (48, noise(L)), (49, "x" * L), (50, "z" * (L + 1))]
    docs += [(51, noise(2000))] * 2 + [(52, "日本" * 300 + noise(100)), (53, "日本" * 300)]
    edited = list(longer)
    for i in range(12):
        edited[rnd.randrange(len(edited))] = "#"
        docs.append((60 + i, "".join(edited)))
    rows = spark.createDataFrame([(i, t, "h") for i, t in docs], "doc_id long, text string, hits string")
    assert got(P.passage_dedup(spark, rows)) == brute(docs)
    assert P.passage_dedup(spark, rows.limit(0)).count() == 0
    kept = {r.doc_id: bytes(r.kept) for r in P.passage_dedup(spark, rows).collect()}
    assert kept[40] == b"" and kept[41].decode() == passage[: L - 1]


def test_column_wise_construction():
    rnd = random.Random(1)
    for width in (8, 32):
        for _ in range(20):
            members = []
            for _ in range(rnd.randint(1, 30)):
                lead, q2 = sorted((rnd.randint(0, width - 1), rnd.randint(0, width - 1)))
                members.append((rnd.randint(0, 2), lead, bytes(rnd.choice(b"ab") if rnd.random() < 0.1 else 97 for _ in range(width - 1 - lead)), bytes(rnd.choice(b"ab") if rnd.random() < 0.1 else 97 for _ in range(q2))))
            found = P.column_wise(np.array([m[0] for m in members]), [m[2] for m in members], [m[3] for m in members], width)
            windows = [{i: (g, x[i - lead :], y[:i], i) for i in range(lead, len(y) + 1)} for g, lead, x, y in members]
            count = Counter(w for ws in windows for w in ws.values())
            assert [[i in ws and count[ws[i]] > 1 for i in range(width)] for ws in windows] == found.tolist()
