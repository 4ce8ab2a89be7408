import random
import re

import numpy as np
import pytest

from trellis.llm import graph, ngram_join

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text, n):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(rows, n, num, den):
    sets = {d: shingles(t, n) for d, t in rows}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in ids}


def corpus(seed):
    rng = random.Random(seed)
    rows = [(0, None), (1, ""), (2, " \n"), (3, "One"), (4, "one"), (5, "one TWO"), (6, "É one two"), (7, "é one two")]
    d = 8
    for size in (12, 20, 40, 90, 300):
        for _ in range(3):
            base = [f"w{rng.randrange(5000)}" for _ in range(size)]
            for _ in range(9):
                text = list(base)
                for _ in range(rng.randrange(1 + size // 12)):
                    i = rng.randrange(len(text))
                    text[i : i + rng.randrange(2)] = [rng.choice(["x", "y z", "q"])] * rng.randrange(3)
                rows.append((d, " ".join(text)))
                d += 1
    return rows + [(d + i, rows[20][1]) for i in range(5)] + [(d + 9, "common line of words here"), (d + 10, "Common line of words here now")]


@pytest.mark.parametrize(("n", "num", "den"), [(3, 9, 10), (5, 4, 5)])
def test_against_brute_force(spark, n, num, den):
    rows = corpus(n)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id int, text string, n int").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_join(df, n, num, den).collect()}
    assert got == brute(rows, n, num, den)


def test_blocks_of_a_large_family(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 7)
    rows = corpus(11)
    df = spark.createDataFrame(rows, "doc_id int, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_join(df).collect()} == brute(rows, 3, 9, 10)


def test_search_is_exact():
    rng = np.random.default_rng(1)
    sets = [np.sort(rng.choice(60, rng.integers(1, 40), replace=False)).astype(np.uint64) for _ in range(200)]
    sets.sort(key=len)
    index = ngram_join.Index(sets)
    for num, den in ((9, 10), (4, 5), (1, 2)):
        for q in [*sets[::7], *(np.sort(rng.choice(90, rng.integers(1, 40), replace=False)).astype(np.uint64) for _ in range(50)), sets[-1] + np.uint64(1)]:
            want = [i for i, s in enumerate(sets) if den * len(np.intersect1d(q, s)) >= num * len(np.union1d(q, s))]
            assert index.search(q, num, den).tolist() == want


@pytest.mark.parametrize(("num", "den"), [(9, 10), (4, 5)])
def test_similar_sets_share_a_key(num, den):
    rng = np.random.default_rng(2)
    level = rng.integers(0, 9, 1 << ngram_join.SKETCH_BITS).astype(np.uint8)
    links = 0
    for _ in range(3000):
        a = np.unique(rng.integers(0, 2**64, rng.integers(2, 400), dtype=np.uint64))
        drop = rng.integers(0, max(1, int(len(a) * (1 - num / den))) + 1)
        b = np.unique(np.concatenate((rng.permutation(a)[drop:], rng.integers(0, 2**64, rng.integers(0, max(1, len(a) // 12) + 1), dtype=np.uint64))))
        both, either = len(np.intersect1d(a, b)), len(np.union1d(a, b))
        if den * both >= num * either:
            links += 1
            assert set(ngram_join.prefix(a, level, num, den).tolist()) & set(ngram_join.prefix(b, level, num, den).tolist())
            assert ngram_join.near(np.array([[len(a)], [len(b)]]), [[ngram_join.signature(a)], [ngram_join.signature(b)]], num, den).all()
    assert links > 500


def test_plausible_forest():
    rng = np.random.default_rng(4)
    base = [np.unique(rng.integers(0, 2**64, size, dtype=np.uint64)) for size in (30, 33, 200, 210, 230)]
    sets = [np.unique(np.concatenate((b[int(k) :], rng.integers(0, 2**64, k, dtype=np.uint64)))) for b in base for k in rng.integers(0, 12, 20)]
    sizes, bits = np.array([len(x) for x in sets]), [ngram_join.signature(x) for x in sets]
    for num, den in ((9, 10), (4, 5)):
        label = list(range(len(sets)))
        for x, y in ngram_join.plausible_forest(sizes, bits, num, den):
            assert label[x] != label[y]
            label = [label[x] if v == label[y] else v for v in label]
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if den * len(np.intersect1d(a, b)) >= num * len(np.union1d(a, b)):
                    assert label[i] == label[j]


@pytest.mark.parametrize(("wide", "widest", "measure"), [(2, 8, (3, 9, 10)), (2, 8192, (5, 4, 5))])
def test_chain_of_near_misses(spark, monkeypatch, wide, widest, measure):
    """Texts in a row share most of their words, the ends none; long shared passages join texts that are no links."""
    monkeypatch.setattr(ngram_join, "WIDE", wide)
    monkeypatch.setattr(ngram_join, "WIDEST", widest)
    monkeypatch.setattr(ngram_join, "BLOCK", 10)
    rng = random.Random(5)
    words = [f"c{rng.randrange(10**6)}" for _ in range(900)]
    rows = [(i, " ".join(words[8 * i : 8 * i + 100])) for i in range(90)] + [(100 + i, " ".join(words[2 * i : 2 * i + 100])) for i in range(20, 60)]
    rows += [(200 + i, " ".join(words[:60] + [f"u{i}w{k}" for k in range(i)])) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_join(df, *measure).collect()} == brute(rows, *measure)


def test_null_and_repeated_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a), (2, a + " x"), (3, b), (4, b + " y"), (5, a), (5, b), (6, b), (6, b), (None, a), (None, "alone"), (7, "z")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(1, 38, 1), (2, 39, 1), (3, 38, 1), (4, 39, 1), (5, 38, 1), (5, 38, 1), (6, 38, 1), (6, 38, 1), (None, 38, None), (None, 1, None), (7, 1, 7)], key=str)


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 100), (201, 200), (202, 201)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 200: 200, 201: 200, 202: 200}


def test_empty_table(spark):
    assert ngram_join.jaccard_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0
