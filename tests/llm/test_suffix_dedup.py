import random
from collections import Counter

import pytest

from trellis.llm import suffix_dedup


def brute(rows, k):
    texts = {d: (t or "").encode() for d, t in rows}
    seen = Counter(t[i : i + k] for t in texts.values() for i in range(len(t) - k + 1))
    out = {}
    for d, t in texts.items():
        gone = [False] * len(t)
        for i in range(len(t) - k + 1):
            if seen[t[i : i + k]] > 1:
                gone[i : i + k] = [True] * k
        spans = sum(x and not (i and gone[i - 1]) for i, x in enumerate(gone))
        out[d] = (len(t), sum(gone), spans, bytes(x for i, x in enumerate(t) if not gone[i]))
    return out


@pytest.mark.parametrize(("seed", "letters", "k"), [(1, "ab", 24), (2, "aé ", 16), (3, "abcdefghijklmnop ß", 20)])
def test_against_brute_force(spark, seed, letters, k):
    rng = random.Random(seed)
    base = "".join(rng.choices(letters, k=120))
    rows = [(0, None), (1, ""), (2, "ab"), (3, "a" * 100), (4, base), (5, base), (6, base[:60] + "Z" + base[60:])]
    for d in range(7, 50):
        text = "".join(rng.choices(letters, k=rng.randrange(70)))
        for _ in range(rng.randrange(4)):
            i, j = rng.randrange(110), rng.randrange(len(text) + 1)
            text = text[:j] + base[i : i + rng.randrange(50)] + text[j:]
        rows.append((d, text))
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n int").repartition(4)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.dedup_bytes(docs, k, max(2, k // 3)).collect()}
    assert got == brute(rows, k)


def test_empty_table(spark):
    assert suffix_dedup.dedup_bytes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_null_and_repeated_ids(spark):
    base = "The quick brown fox jumps over the lazy dog. "
    rows = [(None, base + "x"), (None, None), (1, "own text of the first row"), (1, "then " + base), (1, "own text of the first row"), (2, "other words altogether")]
    seen = Counter((t or "").encode()[i : i + 20] for _, t in rows for i in range(len((t or "").encode()) - 19))
    want = []
    for d, text in rows:
        data = (text or "").encode()
        gone = {i + k for i in range(len(data) - 19) if seen[data[i : i + 20]] > 1 for k in range(20)}
        want.append((d, len(data), len(gone), bytes(x for i, x in enumerate(data) if i not in gone)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept)) for r in suffix_dedup.dedup_bytes(docs, 20, 7).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and sum(r[2] > 0 for r in want) == 4
