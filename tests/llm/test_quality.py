import math
import random
import zlib

import numpy as np
import pytest

from trellis.llm import quality


def corpus(n):
    rng = random.Random(8)
    rows, labels = [], []
    for d in range(n):
        words = ["".join(rng.choices("etaoinshr", k=rng.randrange(1, 9))) for _ in range(rng.randrange(5, 80))]
        bad = d % 4 == 0
        if bad:
            words = [w + rng.choice(["!!", "###"]) for w in words] if rng.random() < 0.5 else [words[0]] * len(words)
        rows.append((d, " ".join(words) + ".", "x"))
        if rng.random() < 0.8:
            labels.append((d, 0 if bad else 1))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus(900)
    docs = spark.createDataFrame([*rows, (5000, None, "x"), (5001, "", "x")], "doc_id int, text string, score string")
    known = spark.createDataFrame([*labels, (None, 1), (9999, 0), (3, None), (4, 7)], "doc_id int, quality int")
    model = quality.train(docs, known)
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert len(got) == len(rows) + 2 and all(0 <= s <= 1 for s in got.values())
    held = [(d, q) for d, q in labels if zlib.crc32(str(d).encode()) % 5 == 0]
    assert len(held) > 80
    assert np.mean([(got[d] >= 0.3) == q for d, q in held]) > 0.97


def test_interactions_are_learned():
    rng = np.random.default_rng(0)
    x = rng.random((4000, len(quality.FEATURES)))
    y = ((x[:, 3] > 0.5) ^ (x[:, 7] > 0.5)).astype(float)
    model = quality.fit(x, y)
    assert (7, 3) in [(i, j) for i, j, _ in model.pairs]
    assert ((model.score(x) > 0.5) == y).mean() > 0.9


def test_no_labels_and_no_documents(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in quality.score(docs, quality.train(docs, none)).collect()] == [0.5]
    empty = docs.filter("false")
    assert quality.score(empty, quality.train(empty, none)).count() == 0


def slow_features(text):
    """The features by their definitions, one character and one word at a time."""
    words, lines, size = text.split(), text.split("\n"), max(1, len(text.encode()))
    plain = [c for c in text if ord(c) < 128]
    upper, lower = sum(c.isupper() for c in plain), sum(c.islower() for c in plain)
    digits = sum(c.isdigit() for c in plain)
    marks = sum(c in ".,;:?'\"()-" for c in plain)
    blank = sum(c.isspace() or ord(c) < 32 for c in plain)
    m, letters = max(1, len(words)), max(1, upper + lower)
    same = [i > 0 and words[i] == words[i - 1] for i in range(len(words))]
    longest = max((j - i for i in range(len(words)) for j in range(i + 1, len(words) + 1) if len(set(words[i:j])) == 1), default=0)
    share = [words.count(w) / m for w in sorted(set(words))] or [1.0]
    return [
        math.log(1 + len(words)), sum(map(len, words)) / m, len(set(words)) / m, len({(words[i], words[i + 1]) for i in range(len(words) - 1)}) / max(1, m - 1), sum(same) / m, max(share),
        -sum(p * math.log(p) for p in share) / math.log(m + 1), sum(len(w) > 12 for w in words) / m, sum(len(w) <= 3 for w in words) / m if words else 1.0, (upper + lower) / size, upper / letters, digits / size,
        marks / size, (len(plain) - upper - lower - digits - marks - blank) / size, sum(w[-1] in "!#$%&*|@^~<>=+_/\\{}[]" for w in words) / m, sum(w in set("!#$%&*|@^~<>=+_/\\{}[]") for w in words) / m,
        sum(c in ".?" for c in text) / m, m / len(lines), 1 - len(set(lines)) / len(lines), sum(w[0].isupper() for w in words) / m, math.log(1 + longest), (len(text.encode()) - len(plain)) / size,
    ]


def test_features_by_their_definitions():
    rng = random.Random(3)
    texts = ["", " ", "\n\n", "a", "A a A", "é ü ß 中文 \U0001f600", "x" * 5000, "# # #", "one.\none.\n\ttwo?\x01\x7f", "\u2003wide\u00a0space"]
    texts += ["".join(rng.choices("abcDE 12.,!#\n\té中", k=rng.randrange(200))) for _ in range(200)]
    for text in texts:
        assert quality.features(text) == pytest.approx(slow_features(text), abs=1e-12), text


def slow_tree(values, slope, weight):
    """bin -> value of the tree of four leaves, grown by the best single cut."""
    bins = range(max(values) + 1)
    g = [sum(s for v, s in zip(values, slope) if v == b) for b in bins]
    h = [sum(w for v, w in zip(values, weight) if v == b) for b in bins]
    worth = lambda a, b: sum(g[a:b]) ** 2 / (sum(h[a:b]) + 2)
    parts = [(0, len(g))]
    while len(parts) < 4:
        cuts = [(worth(a, c) + worth(c, b) - worth(a, b), (a, b), c) for a, b in parts for c in range(a + 1, b)]
        if not cuts or max(cuts)[0] <= 1e-9:
            break
        _, (a, b), c = max(cuts)
        parts = [p for p in parts if p != (a, b)] + [(a, c), (c, b)]
    return {i: -sum(g[a:b]) / (sum(h[a:b]) + 2) for a, b in parts for i in range(a, b)}


def slow_quarter(rows, columns, slope, weight):
    """Gain of the best cut of a grid into four, and the value of every sample."""
    best = (-1.0, None)
    for r in range(1, max(rows) + 1):
        for c in range(1, max(columns) + 1):
            side = [(x >= r, y >= c) for x, y in zip(rows, columns)]
            sums = {q: (sum(s for p, s in zip(side, slope) if p == q), sum(w for p, w in zip(side, weight) if p == q)) for q in set(side)}
            gain = sum(g * g / (h + 2) for g, h in sums.values())
            if gain > best[0]:
                best = (gain, [-sums[q][0] / (sums[q][1] + 2) for q in side])
    return best


def test_boosting_by_hand(monkeypatch):
    monkeypatch.setattr(quality, "ROUNDS", 4)
    monkeypatch.setattr(quality, "PAIR_ROUNDS", 3)
    monkeypatch.setattr(quality, "PAIRS", 2)
    monkeypatch.setattr(quality, "BINS", 6)
    monkeypatch.setattr(quality, "PAIR_BINS", 4)
    rng = np.random.default_rng(2)
    x = rng.random((90, 3))
    y = ((x[:, 0] > 0.4) ^ (x[:, 1] > 0.6)).astype(float)
    model = quality.fit(x, y)
    total = [math.log(y.mean() / (1 - y.mean()))] * len(y)
    bins = [[sum(c <= v for c in quality.quantile_cuts(x[:, f], 6)) for v in x[:, f]] for f in range(3)]
    coarse = [[sum(c <= v for c in quality.quantile_cuts(x[:, f], 4)) for v in x[:, f]] for f in range(3)]

    def slope():
        p = [1 / (1 + math.exp(-t)) for t in total]
        return [a - b for a, b in zip(p, y)], [a * (1 - a) for a in p]

    for _ in range(4):
        for f in range(3):
            tree = slow_tree(bins[f], *slope())
            total = [t + quality.RATE * tree[b] for t, b in zip(total, bins[f])]
    pairs = sorted(((slow_quarter(coarse[i], coarse[j], *slope())[0], i, j) for i in range(3) for j in range(i)), reverse=True)[:2]
    assert [(i, j) for i, j, _ in model.pairs] == [(i, j) for _, i, j in pairs]
    for _ in range(3):
        for _, i, j in pairs:
            step = slow_quarter(coarse[i], coarse[j], *slope())[1]
            total = [t + quality.RATE * s for t, s in zip(total, step)]
    assert model.score(x) == pytest.approx([1 / (1 + math.exp(-t)) for t in total], abs=1e-9)
