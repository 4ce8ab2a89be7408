import random

import pytest

from trellis.llm import substring_dedup


def brute(rows, k):
    words = {d: (t or "").encode().split() for d, t in rows}
    first = {}
    for d in sorted(words):
        for i in range(len(words[d]) - k + 1):
            first.setdefault(tuple(words[d][i : i + k]), d)
    out = {}
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - k + 1):
            if first[tuple(w[i : i + k])] < d:
                gone.update(range(i, i + k))
        out[d] = (len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode())
    return out


def corpus(seed, vocabulary):
    rng = random.Random(seed)
    word = lambda: rng.choice(vocabulary)
    base = [word() for _ in range(80)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one")]
    for d in range(4, 60):
        text = [word() for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(4)):
            i = rng.randrange(70)
            text[len(text) // 2 : len(text) // 2] = base[i : i + rng.randrange(40)]
        rows.append((d, rng.choice([" ", "\n", " \x0b "]).join(text)))
    rows += [(60 + i, " ".join(base)) for i in range(6)] + [(70, "x " * 500), (71, "x " * 90)]
    return rows


@pytest.mark.parametrize(("seed", "vocabulary", "k"), [(1, ["a", "b"], 12), (2, ["é", "B", "b", "ø y", "."], 10), (3, [str(i) for i in range(300)], 8)])
def test_against_brute_force(spark, seed, vocabulary, k):
    rows = corpus(seed, vocabulary)
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id int, text string, runs string").repartition(5)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.dedup_words(docs, k, max(2, k // 2)).collect()}
    assert got == brute(rows, k)


def test_empty_table(spark):
    assert substring_dedup.dedup_words(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_document_that_repeats_a_passage_of_another_in_the_same_surroundings(spark):
    rng = random.Random(4)
    some = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage, around = some(120), [some(60), some(60)]
    rows = [(3, " ".join(some(60) + passage + some(60))), (5, " ".join((around[0] + passage + around[1]) * 4)), (9, " ".join(around[0] + passage + some(60)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.dedup_words(docs, 50, 25).collect()}
    assert got == brute(rows, 50)


def test_null_and_repeated_ids(spark):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(40)]
    part = lambda: " ".join(base[(i := rng.randrange(20)) : i + rng.randrange(8, 20)] + [f"u{rng.randrange(10**6)}"] * rng.randrange(3))
    rows = [(i % 7, " ".join(part() for _ in range(rng.randrange(1, 4)))) for i in range(40)] + [(None, " ".join(base)), (None, " ".join(base)), (3, None), (-5, " ".join(base[:12]))]
    rows += [rows[0], rows[0]]
    want = []
    for d, text in rows:
        words = (text or "").split()
        smaller = {tuple(w[i : i + 10]) for e, t in rows if d is not None and e is not None and e < d for w in [(t or "").split()] for i in range(len(w) - 9)}
        gone = {i + k for i in range(len(words) - 9) if tuple(words[i : i + 10]) in smaller for k in range(10)}
        want.append((d, len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    docs = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, key int").repartition(3)
    got = [tuple(r) for r in substring_dedup.dedup_words(docs, 10, 5).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and any(r[2] for r in want)


def test_compaction(spark):
    """Paths end where a node branches, where the source has a gap, and after ``LENGTH`` edges."""
    rows = [(1, 0, 0, 3, 10, 11), (1, 0, 3, 4, 11, 12), (1, 0, 7, 2, 12, 13), (1, 0, 20, 5, 13, 14), (2, 0, 0, 5, 12, 30), (1, 1, 0, 1, 50, 51), (1, 1, 1, 1, 51, 52)]
    got = {(r.source, r.layer, r.pos): r.head for r in substring_dedup.compact(spark.createDataFrame(rows, "key long, layer int, pos int, n int, left long, right long")).collect()}
    assert got == {(1, 0, 0): 0, (1, 0, 3): 0, (1, 0, 7): 7, (1, 0, 20): 20, (2, 0, 0): 0, (1, 1, 0): 0, (1, 1, 1): 0}
    long = [(9, 0, 300 * i, 300, i, i + 1) for i in range(5)]
    assert [r.head for r in substring_dedup.compact(spark.createDataFrame(long, "key long, layer int, pos int, n int, left long, right long")).orderBy("pos").collect()] == [0, 0, 600, 600, 1200]


def test_spans_are_verified_at_their_source(spark):
    rows = [(1, 0, 2, 1, b"b c d", b"a b c d"), (2, 0, 2, 1, b"b c x", b"a b c d"), (3, 5, 1, 0, b"a b", b"a b c d")]
    pairs = spark.createDataFrame(rows, "key long, start int, n int, off int, words binary, path_words binary")
    assert sorted(tuple(r) for r in substring_dedup.agreeing(pairs, 2).collect()) == [(1, 0, 2), (3, 5, 1)]
