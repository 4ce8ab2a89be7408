"""Steps whose work must grow no faster than their input."""

import math

import numpy as np
import pytest
from fixtures import block
from pyspark.sql import functions as F

from trellis.operators import interpolation, spatial, stats


def cloud(spark, rows):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(rows)], "nid long, x double, y double, z double")


def test_nearest_search_starts_small_in_dense_clouds_and_drops_copies(spark):
    """a few far nodes and many copies make no point meet a large part of the cloud."""
    rng = np.random.default_rng(1)
    rows = [*rng.random((400, 3)), *rng.random((4, 3)) * 1000, *[(0.5, 0.5, 0.5)] * 40]
    nodes = cloud(spark, rows).cache()
    low, high, n = spatial.extent(nodes)
    h = spatial.first_radius(nodes, low, high, n, 3)
    points = nodes.select(F.col("nid").alias("q"), (F.col("x") + 0.01).alias("x"), "y", "z")
    assert spatial.candidates(points, "q", nodes.filter("nid < 404"), low, h).count() < 444 * 150
    got = {(r.q, r.rank): (r.nid, r.dist2) for r in spatial.k_nearest(points, "q", nodes, 3).collect()}
    assert len(got) == 3 * len(rows)
    for q, p in enumerate(rows):
        at = (p[0] + 0.01, p[1], p[2])
        d2 = lambda o: (o[0] - at[0]) ** 2 + (o[1] - at[1]) ** 2 + (o[2] - at[2]) ** 2  # noqa: B023, E731
        want = sorted((d2(o), i) for i, o in enumerate(rows))[:3]
        for rank, (d, i) in enumerate(want, 1):
            assert got[q, rank] == (i, pytest.approx(d, rel=1e-12))


def test_elements_are_found_by_their_size(spark):
    """an element is placed in 8 cells of its own level at most, and its points are all found."""
    nodes = cloud(spark, [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1), (90, 0, 0), (0, 90, 0), (0, 0, 90)])
    elements = spark.createDataFrame([(0, "Tt", [0, 4, 5, 6], 1, []), *((i, "Tt", [0, 1, 2, 3], 1, []) for i in range(1, 40))], "eid long, etype string, con array<long>, tag long, fib array<double>")
    mesh = type(block(spark))(nodes, elements)
    points = spark.createDataFrame([(0, 0.1, 0.1, 0.1), (1, 20.0, 20.0, 20.0), (2, 60.0, 60.0, 60.0)], "q long, x double, y double, z double")
    found = spatial.containing(points, "q", mesh)
    assert found.groupBy("q").count().orderBy("q").collect() == [(0, 40), (1, 1)]
    least = {r.q: (r.eid, r.w) for r in spatial.enclosing(points, "q", mesh).collect()}
    assert set(least) == {0, 1} and least[1] == (0, pytest.approx([1 - 2 / 3, 2 / 9, 2 / 9, 2 / 9])) and math.isclose(sum(least[0][1]), 1)


def test_global_weights_in_blocks(spark, monkeypatch):
    """pairs of small blocks add up to the mean over all, copies of cloud rows count as often as they are there."""
    monkeypatch.setattr(interpolation, "CLOUD_BLOCK", 7)
    monkeypatch.setattr(interpolation, "POINT_BLOCK", 5)
    rng = np.random.default_rng(2)
    rows = [*rng.random((30, 4)), *[(0.2, 0.2, 0.2, 3.0)] * 12]
    points = spark.createDataFrame([(i, *map(float, p[:3])) for i, p in enumerate([*rng.random((17, 3)), rows[4]])], "idx long, x double, y double, z double")
    values = spark.createDataFrame([tuple(map(float, p)) for p in rows], "x double, y double, z double, value double")
    got = {r.idx: r.value for r in interpolation.shepard_global(points, values).collect()}
    assert len(got) == 18 and got[17] == rows[4][3]
    for r in points.filter("idx < 17").collect():
        w = [1 / ((x - r.x) ** 2 + (y - r.y) ** 2 + (z - r.z) ** 2) ** 2 for x, y, z, _ in rows]
        assert got[r.idx] == pytest.approx(sum(a * p[3] for a, p in zip(w, rows)) / sum(w))
    assert interpolation.blocks(values, 7, "b").count() > 1


def test_radial_basis_in_blocks(spark, monkeypatch):
    """pairs of small blocks add up to what one pair gives."""
    monkeypatch.setattr(interpolation, "PAIR_TASKS", 4)
    at = np.random.default_rng(3).random((40, 3))
    rows = spark.createDataFrame([(i, *map(float, p), 1.0 + float(p[0])) for i, p in enumerate(at)], "nid long, x double, y double, z double, value double").cache()
    points = rows.select(F.col("nid").alias("idx"), (F.col("x") + 0.01).alias("x"), "y", "z")
    want = {r.idx: r.value for r in interpolation.radial_basis(points, rows, 8, 3).collect()}
    monkeypatch.setattr(interpolation, "FIT_BLOCK", 6)
    got = {r.idx: r.value for r in interpolation.radial_basis(points, rows, 8, 3).collect()}
    assert set(want) == set(range(40)) and got == pytest.approx(want, rel=1e-9)


def test_edges_meet_only_triangles_near_them(spark):
    """a strip of triangles across x meets by cells, not all with all."""
    n = 200
    nodes = cloud(spark, [(x, y, 0) for y in range(n + 1) for x in (0, 1)])
    rows = [(2 * y + k, "Tr", [2 * y + k, 2 * y + 1 + k, 2 * y + 2 + k], 1, []) for y in range(n) for k in (0, 1)]
    mesh = type(block(spark))(nodes, spark.createDataFrame(rows, "eid long, etype string, con array<long>, tag long, fib array<double>"))
    assert stats.meeting(mesh).count() < 40 * len(rows)
    assert stats.self_intersections(mesh).count() == 0
