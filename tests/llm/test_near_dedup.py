"""Near-dedup against brute force over all pairs."""

import random
import re

import numpy as np

from windlake.llm import near_dedup as N


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute(docs):
    sets = {i: plain_set(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids, where = sorted(sets), {}
    for i in ids:
        for s in sets[i]:
            where.setdefault(s, []).append(i)
    near = {(a, b) for v in where.values() for k, a in enumerate(v) for b in v[k + 1 :]}
    for a, b in near:
        both = len(sets[a] & sets[b])
        if 100 * both >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def test_on_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert got(N.op8_near_dedup(spark, sf)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_edits_chains_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 16)  # several blocks
    rnd = random.Random(5)
    base = [f"w{rnd.randint(0, 999)}" for _ in range(120)]
    docs = []
    for i in range(150):
        words = list(base)
        for _ in range(rnd.randint(0, 12)):
            words[rnd.randrange(len(words))] = f"e{rnd.randint(0, 9999)}"
        docs.append((1000 + i, " ".join(words)))
    chain = list(base[:60])
    for i in range(12):  # neighbours are near, ends are not
        chain = chain[2:] + [f"c{i}a", f"c{i}b"]
        docs.append((2000 + i, "chain " + " ".join(chain)))
    docs += [(1, None), (2, ""), (3, " \n\t"), (4, "One two"), (5, "one TWO"), (6, "É two"), (7, "é two"), (8, "a b c d e"), (9, "A  b\vc d\fe"), (10, "a b c d e f"), (11, "x" * 9000), (4, "One two")]
    rows = spark.createDataFrame([(i, t, "z") for i, t in docs] + [(None, "one two", "z")], "doc_id long, text string, bands string")
    out = got(N.near_dedup(spark, rows))
    assert out.pop(None) == (1, None, True)
    assert out == brute(dict(docs).items())
    assert N.near_dedup(spark, rows.limit(0)).count() == 0


def test_large_buckets_by_rare_shingles(spark, monkeypatch):
    """Texts that share a long passage but aren't near, in buckets and crowds over the bound; some pairs of them are near."""
    monkeypatch.setattr(N, "BLOCK", 8)
    rnd = random.Random(9)
    words = lambda n, tag: [f"{tag}{rnd.randint(0, 10**9)}" for _ in range(n)]
    common, docs = words(120, "c"), []
    for group in range(4):
        shared = words(50, f"g{group}")
        for i in range(25):
            own = words(45, "o")
            docs.append(" ".join(common + shared + own))
            if i % 5 == 0:
                docs.append(" ".join(common + shared + own[:-12] + words(12, "e")))
    rnd.shuffle(docs)
    seen = []
    by_rare = N._by_rare_shingles
    monkeypatch.setattr(N, "_by_rare_shingles", lambda *a: seen.append(1) or by_rare(*a))
    rows = list(enumerate(docs))
    assert got(N.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
    assert seen


def test_estimate_is_collision_corrected():
    rng = np.random.default_rng(4)
    for j in (0.2, 0.5, 0.8):
        est = []
        for _ in range(30):
            common = rng.integers(0, 1 << 62, int(1000 * j), dtype=np.uint64)
            sets = [np.unique(np.concatenate([common, rng.integers(0, 1 << 62, (1000 - len(common)) // 2, dtype=np.uint64)])) for _ in "ab"]
            x, y = (N.packed_bits(N.min_hashes(s)).view(np.uint64) for s in sets)
            d = x ^ y
            d |= d >> np.uint64(2)
            d |= d >> np.uint64(1)
            equal = 1 - np.bitwise_count(d & N._LOW).sum() / N.K
            est.append((equal - 2.0**-N.BITS) / (1 - 2.0**-N.BITS))
        assert abs(np.mean(est) - j) < 0.03
