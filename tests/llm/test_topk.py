import random

from pyspark.sql import functions as F

from trellis.llm import topk


def test_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice([0.0, 0.0, rng.uniform(-1, 1), 0.25]) for _ in range(9)]) for i in range(300)]
    rows += [(300, None), (301, [float("nan")] * 9), (302, [None] * 9), (303, []), (320, rows[7][1]), (340, rows[7][1]), (400, [1e9] * 9), (401, [-1e9] * 9)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string")
    df = df.select("vec_id", topk.quantised(F.col("embedding")).alias("vector")).filter("vector is not null")
    got = {}
    for r in topk.top_k(df.filter("vec_id % 20 = 0"), df, 5, query_block=4, row_block=50).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    whole = {i: [__import__("math").floor(64 * x) for x in v] for i, v in rows if v and None not in v and v[0] == v[0]}
    for q in (i for i in whole if i % 20 == 0):
        best = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:5]
        assert sorted(got[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert set(got) == {i for i in whole if i % 20 == 0}


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1]), (1, [2])], "vec_id long, vector array<long>")
    assert [tuple(r) for r in topk.top_k(df.filter("vec_id = 0"), df, 20).collect()] == [(0, 1, 1, 2)]
    assert topk.top_k(df.filter("vec_id = 5"), df, 20).count() == 0
    assert topk.top_k(df.filter("vec_id = 5"), df.filter("vec_id = 5"), 20).count() == 0


def test_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(0, [1, 0]), (0, [0, 1]), (None, [9, 9]), (1, [2, 1]), (2, [1, 3])], "vec_id long, vector array<long>")
    got = sorted(tuple(r) for r in topk.top_k(df.filter("vec_id = 0 or vec_id is null"), df, 1).collect())
    assert got == [(0, 1, 2, 3)]
    assert {(r.query_id, r.vec_id) for r in topk.top_k(df.filter("vec_id = 1"), df, 20).collect()} == {(1, 0), (1, 2)}
