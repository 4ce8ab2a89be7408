"""Fixed points by blocks: the same results in any number of blocks, in rounds that don't go by the layers of nodes."""

import heapq
import math
from collections import deque

import numpy as np
import pytest
from fixtures import block
from pyspark.sql import functions as F

from trellis.model import Mesh
from trellis.operators import blocks, graph, smoothing, surface
from trellis.plans import hosts


@pytest.fixture
def small(monkeypatch):
    """Blocks of few nodes, and the number of tables that solving them writes."""
    written = []
    keep = blocks.cut
    monkeypatch.setattr(blocks, "BLOCK", 60)
    monkeypatch.setattr(blocks, "cut", lambda df: written.append(1) or keep(df))
    return written


def chain(spark, n):
    nodes = spark.range(n).select(F.col("id").alias("nid"), F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    ends = F.array("id", F.col("id") + 1)
    return Mesh(nodes, spark.range(n - 1).select(F.col("id").alias("eid"), F.lit("Ln").alias("etype"), ends.alias("con"), F.lit(1).cast("long").alias("tag"), F.array().cast("array<double>").alias("fib")))


def box(spark, tmp_path, parts=64):
    spark.range(parts).selectExpr("id as p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    mesh = hosts.box_mesh(spark, str(tmp_path))
    return Mesh(mesh.nodes.cache(), mesh.elements.cache())


def test_fronts_cross_blocks_not_layers(spark, small):
    """a front along 150 nodes takes a few tables, and its values are exact."""
    mesh = chain(spark, 150)
    start = mesh.nodes.filter("nid = 0").select("nid")
    assert {r.nid: r.value for r in graph.eikonal(mesh, start).collect()} == {i: float(i) for i in range(150)}
    assert {r.nid: r.value for r in graph.graph_distance(mesh, start).collect()} == {i: float(i) for i in range(150)}
    ahead = mesh.nodes.select(F.col("nid").alias("idx"), F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0)).alias("value"))
    seeds = spark.createDataFrame([(3, 7.5)], "nid long, value double")
    assert {tuple(r) for r in graph.transport(mesh, seeds, ahead, far=100.5).collect()} == {(i, 3, 7.5) for i in range(3, 104)}
    assert len(small) < 3 * 8


def test_distances_over_blocks(spark, small, tmp_path):
    """as with one block, and as by a queue."""
    mesh = box(spark, tmp_path)
    start = mesh.nodes.filter("nid = 0").select("nid")
    at = {r.nid: (r.x, r.y, r.z) for r in mesh.nodes.collect()}
    near = {}
    for r in mesh.elements.collect():
        for a in r.con:
            near.setdefault(a, set()).update(r.con)
    want, heap = {}, [(0.0, 0)]
    while heap:
        d, a = heapq.heappop(heap)
        if a not in want:
            want[a] = d
            for b in near[a] - {a}:
                heapq.heappush(heap, (d + math.sqrt(sum((p - q) ** 2 for p, q in zip(at[b], at[a]))), b))
    assert {r.nid: r.value for r in graph.graph_distance(mesh, start).collect()} == pytest.approx(want, rel=1e-12)
    many = {r.nid: r.value for r in graph.eikonal(mesh, start).collect()}
    blocks.BLOCK = 10_000
    assert many == pytest.approx({r.nid: r.value for r in graph.eikonal(mesh, start).collect()}, rel=1e-4)
    assert all(v <= want[i] + 1e-9 and v >= math.dist(at[i], at[0]) - 1e-9 for i, v in many.items())


def test_bad_elements_go_back_round_by_round(spark, small, tmp_path):
    """The rounds of all elements at once, replayed in blocks."""
    mesh = box(spark, tmp_path)
    rng = np.random.default_rng(6)
    old = {r.nid: (r.x, r.y, r.z) for r in mesh.nodes.collect()}
    new = {i: tuple(float(v) for v in np.array(p) + rng.normal(0, 0.12, 3)) for i, p in old.items()}
    con = np.array([r.con for r in mesh.elements.collect()])
    quality = lambda at: smoothing.tet_qualities(np.array([[at[i] for i in c] for c in con.tolist()]))
    before, now, rounds = quality(old), dict(new), 0
    while True:
        value = quality(now)
        bad = con[(value > 0.5) & (value > before)]
        if not len(bad):
            break
        rounds += 1
        now.update({i: old[i] for i in np.unique(bad).tolist()})
    assert rounds > 1 and now != old
    moved = Mesh(spark.createDataFrame([(i, *p) for i, p in new.items()], "nid long, x double, y double, z double"), mesh.elements)
    assert {r.nid: (r.x, r.y, r.z) for r in smoothing.guarded(mesh, moved, 0.5).nodes.collect()} == now


def test_parts_join_up_in_pieces(spark, monkeypatch):
    """a long path takes few rounds over few links, whatever its ids."""
    monkeypatch.setattr(graph, "PIECE", 10)
    seen = []
    keep = graph.spread
    monkeypatch.setattr(graph, "spread", lambda links: seen.append(links.count()) or keep(links))
    rows = [(3 * i, 3 * i + 3) for i in range(120)] + [(1, 4), (4, 1), (7, 4)]
    links = spark.createDataFrame(rows, "a long, b long").repartition(1)
    got = {r.node: r.component for r in graph.components(links, spark.createDataFrame([(500,), (0,)], "node long")).collect()}
    assert got == {500: 500, 0: 0}
    got = {r.node: r.component for r in graph.components(links).collect()}
    assert got == {**{3 * i: 0 for i in range(121)}, 1: 1, 4: 1, 7: 1} and max(seen) < 30


def test_flood_and_patches_by_parts(spark, tmp_path):
    """a flood over a side of the box."""
    mesh = box(spark, tmp_path, 27)
    rows = surface.boundary(mesh)
    side = surface.restrict_by_seeds(mesh, rows, [(1.5, 1.5, -1.0)], edge=45.0)
    assert side.count() == 18 and sorted(r["count"] for r in surface.patches(mesh, rows, 45.0).groupBy("patch").count().collect()) == [18] * 6
    assert surface.patches(block(spark), surface.boundary(block(spark))).select("patch").distinct().count() == 1


def queue_order(nodes, cells):
    """Ranks by a queue: from the least node of each part, neighbours in order of id, all reversed."""
    near = {i: set() for i in nodes}
    for c in cells:
        for a in c:
            near[a].update(c)
    order = {}
    for root in sorted(nodes):
        queue = deque([root] if root not in order else [])
        order.setdefault(root, len(order))
        while queue:
            for b in sorted(near[queue.popleft()]):
                if b not in order:
                    order[b] = len(order)
                    queue.append(b)
    return {i: len(order) - 1 - at for i, at in order.items()}


def test_order_goes_by_links_not_by_layers(spark, small, monkeypatch):
    """149 layers take a few tables."""
    keep = graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: small.append(1) or keep(df))
    mesh = chain(spark, 150)
    assert {r.nid: r.rank for r in graph.reverse_cuthill_mckee(mesh).collect()} == {i: 149 - i for i in range(150)}
    assert len(small) < 40


@pytest.mark.parametrize("strip", [4, 60, 4_000_000])
def test_order_is_that_of_a_queue(spark, small, monkeypatch, strip):
    """wide layers, strips of several layers and one strip; parts of several sizes, shuffled ids, nodes without elements."""
    monkeypatch.setattr(graph, "STRIP", strip)
    rng = np.random.default_rng(28)
    m = 5
    at = lambda i, j, k: i + m * j + m * m * k
    hexes = [[at(i + a, j + b, k + c) for c in (0, 1) for b in (0, 1) for a in (0, 1)] for i in range(m - 1) for j in range(m - 1) for k in range(m - 1) if i != 2]
    cells = [h[:4] if n % 3 == 0 else h for n, h in enumerate(hexes)] + [[200, 205, 203], [203, 201], [210, 211, 212, 213]]
    ids = [*range(m**3), *range(200, 206), *range(210, 214), 300]
    new = dict(zip(ids, (int(v) for v in rng.permutation(1000)[: len(ids)])))
    cells = [[new[i] for i in c] for c in cells]
    nodes = [(new[i], *(float(v) for v in rng.uniform(0, 4, 3))) for i in ids]
    elements = [(e, {2: "Ln", 3: "Tr", 4: "Qd", 8: "Hx"}[len(c)], c, 1, [1.0, 0.0, 0.0]) for e, c in enumerate(cells)]
    mesh = Mesh(spark.createDataFrame(nodes, "nid long, x double, y double, z double"), spark.createDataFrame(elements, "eid long, etype string, con array<long>, tag long, fib array<double>"))
    assert {r.nid: r.rank for r in graph.reverse_cuthill_mckee(mesh).collect()} == queue_order([r[0] for r in nodes], cells)
