"""The n-gram join against brute force over all pairs."""

import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from windlake.llm import ngram_join as J


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def components(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {i: find(i) for i in ids}


def near(x, y):
    both = len(x & y)
    return bool(both) and 100 * both >= 80 * (len(x) + len(y) - both)


def brute(docs):
    sets = {i: plain_set(t) for i, t in docs}
    where = {}
    for i in sorted(sets):
        for s in sets[i]:
            where.setdefault(s, []).append(i)
    pairs = {p for v in where.values() for p in combinations(v, 2)}
    found = components(sets, [(a, b) for a, b in pairs if near(sets[a], sets[b])])
    return {i: (len(sets[i]), found[i]) for i in sets}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_on_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert got(J.op11_ngram_join(spark, sf)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def edited(rnd, words, share):
    return [f"e{rnd.randint(0, 10**6)}" if rnd.random() < share else w for w in words]


@pytest.mark.parametrize("members", [2000, 16])
def test_edits_templates_chains_and_odd_rows(spark, monkeypatch, members):
    """Families just over and under the threshold; with 16 members to a block, all of them by pairs of blocks."""
    monkeypatch.setattr(J, "BLOCK_SETS", members)
    rnd = random.Random(5)
    words = lambda n: [f"w{rnd.randint(0, 10**6)}" for _ in range(n)]
    docs, base, template = [], words(120), words(90)
    docs += [(1000 + i, " ".join(edited(rnd, base, rnd.choice([0, 0.005, 0.01, 0.02, 0.03])))) for i in range(120)]
    docs += [(2000 + i, " ".join(template + words(rnd.randint(8, 30)))) for i in range(80)]
    chain = words(60)
    for i in range(12):  # neighbours are near, ends are not
        chain = chain[1:] + words(2)
        docs.append((3000 + i, " ".join(chain)))
    docs += [(1, None), (2, ""), (3, " \n\t"), (4, "One two"), (5, "one TWO"), (6, "É two"), (7, "é two"), (8, "a b c d e"), (9, "A  b\vc d\fe"), (10, "a b c d e f"), (11, "x" * 9000)]
    rnd.shuffle(docs)
    rows = spark.createDataFrame([(i, t, "z") for i, t in docs] + [(4, "One two", "z"), (None, "one two", "z")], "doc_id long, text string, window string")
    out = got(J.ngram_join(spark, rows))
    assert out.pop(None) == (1, None)
    assert out == brute(docs)
    assert J.ngram_join(spark, rows.limit(0)).count() == 0


def test_repeated_ids_with_other_texts(spark):
    rows = [(5, "a b c d e f g"), (5, "q r s t u v w"), (7, "A b c d e f g"), (3, "q r s t u v w"), (9, "other words here")]
    out = sorted((r.doc_id, r.component_id) for r in J.ngram_join(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert out == [(3, 3), (5, 3), (5, 5), (7, 5), (9, 9)]


def test_merge_skip_counts_as_brute_force():
    rnd = random.Random(2)
    for _ in range(300):
        lists = [sorted(rnd.sample(range(40), rnd.randint(0, 25))) for _ in range(rnd.randint(1, 9))]
        least = rnd.randint(1, 6)
        count = {v: sum(v in x for x in lists) for v in range(40)}
        assert J.merge_skip(lists, least) == {v: c for v, c in count.items() if c >= least}


def test_divide_skip_joins_as_all_pairs_do():
    rng, rnd = np.random.default_rng(3), random.Random(3)
    for size in (6, 40, 200):
        base = rng.integers(0, 1 << 62, size, dtype=np.uint64)
        sets = []
        for _ in range(60):
            keep = base[rng.random(size) > rnd.choice([0, 0.05, 0.1, 0.15])]
            sets.append(np.unique(np.concatenate([keep, rng.integers(0, 1 << 62, rnd.randint(1, max(1, size // 8)), dtype=np.uint64)])))
        ids = np.arange(60)
        links = J.divide_skip(ids, ids.copy(), np.zeros(60, np.int64), sets)
        whole = [set(s.tolist()) for s in sets]
        pairs = [(a, b) for a, b in combinations(range(60), 2) if near(whole[a], whole[b])]
        assert components(range(60), links) == components(range(60), pairs)
        assert set(map(lambda p: tuple(sorted(p)), links)) <= set(pairs)
        blocks = np.arange(60) % 2
        links = J.divide_skip(ids, ids.copy(), blocks, sets)
        assert components(range(60), links) == components(range(60), [p for p in pairs if blocks[p[0]] != blocks[p[1]]])


def test_long_lists_leave_one_to_merge():
    assert all(0 <= J.long_lists(t, m) < t for t in range(1, 200) for m in (1, 2, 50, 10**6))


def test_shingle_sets_of_a_batch():
    texts = ["", " ", "a b c d e f", "a b c d e", "A B c d e\n", "a b", "ab", "x" * 50, "é É b c d e f g", "tail "]
    sets = J.shingle_sets(pa.array(texts))
    assert [len(s) for s in sets] == [len(plain_set(t)) for t in texts]
    assert sets[3].tolist() == sets[4].tolist() and set(sets[3].tolist()) < set(sets[2].tolist())
    assert [s.tolist() for s in J.shingle_sets(pa.array(["q", *texts])[1:])] == [s.tolist() for s in sets]
