import random

from trellis.llm import decontamination as D


def brute(docs, items, n, num, den):
    out = set()
    for i, t in items:
        a = D.shingles((t or "").encode(), n)
        for d, x in docs:
            both = len(a & D.shingles((x or "").encode(), n))
            if a and den * both >= num * len(a):
                out.add((d, i, both, len(a)))
    return out


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)] + ["É", "The", "the,"]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, text(rng.choice([5, 7, 12, 25, 60, 130]))) for i in range(40)]
    docs = [(0, None), (1, ""), (2, "a b c")]
    for d in range(3, 160):
        words = text(rng.choice([3, 40, 300, 3000]))
        for _ in range(rng.randrange(3)):
            part = list(rng.choice(items)[1])
            for _ in range(rng.randrange(3)):
                part[rng.randrange(len(part))] = "edited"
            part = [w.upper() if rng.random() < 0.2 else w for w in part]
            at = rng.randrange(len(words) + 1)
            words[at:at] = part
        docs.append((d, rng.choice([" ", "\n"]).join(words)))
    items = [(i, " ".join(t)) for i, t in items] + [(90, None), (91, ""), (92, "too short"), (93, " ".join(items[3][1]))]
    df = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, item_id int").repartition(3)
    bench = spark.createDataFrame(items, "item_id int, text string")
    want = brute(docs, items, 5, 4, 5)
    assert len(want) > 60
    got = sorted(map(tuple, D.leaks(df, bench).collect()))
    assert got == sorted(want)
    kept = D.clean(df, bench)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {x[0] for x in want}
    monkeypatch.setattr(D, "ITEM_BYTES", 900)
    assert sorted(map(tuple, D.leaks(df, bench).collect())) == got


def test_scattered_shingles_are_found(spark):
    words = [f"a{i}" for i in range(60)]
    parts = [" ".join(words[i : i + 20]) for i in (0, 16, 32, 40)]
    filler = [" ".join(f"f{k}x{i}" for i in range(700)) for k in range(3)]
    doc = " ".join(x for pair in zip(parts, [*filler, ""]) for x in pair)
    got = D.leaks(spark.createDataFrame([(1, doc)], "doc_id long, text string"), spark.createDataFrame([(7, " ".join(words))], "item_id long, text string")).collect()
    assert [tuple(r) for r in got] == [(1, 7, 56, 56)]


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert D.leaks(docs, items).count() == 0
    assert D.leaks(spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string"), items).count() == 0


def test_items_of_few_shingles_are_found(spark):
    rng = random.Random(8)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    items = [(i, " ".join(words(5 + i % 4))) for i in range(1200)]
    docs = [(i, f"{t} {' '.join(words(60))}") for i, t in items]
    got = D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect())) == [(i, i, 1 + i % 4, 1 + i % 4) for i in range(1200)]
