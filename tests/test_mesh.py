import math

import numpy as np
import pytest
from fixtures import block
from pyspark.sql import functions as F

from trellis.functions import geometry as G
from trellis.operators import attributes, graph, interpolation, select, series, smoothing, spatial, stats, surface, voxels


@pytest.fixture(scope="module")
def mesh(spark):
    m = block(spark)
    return type(m)(m.nodes.cache(), m.elements.cache())


def test_statistics(mesh):
    v = stats.summary(stats.volumes(mesh), "value").first()
    assert (v.n, round(v.total, 3), round(v.lo, 3), round(v.hi, 3)) == (40, 1e9, 20833333.333, 41666666.667)
    q = stats.summary(stats.quality(mesh), "value").first()
    assert q.hi == pytest.approx(0.2301996411) and q.lo == pytest.approx(0, abs=1e-12)
    assert q["mean"] == pytest.approx(0.1841597129) and q.sd == pytest.approx(0.0932528956)
    e = stats.summary(stats.edge_lengths(mesh).select(F.sqrt("len2").alias("value")), "value").first()
    assert e.n == 90 and e["mean"] == pytest.approx(582.8427125)
    c = stats.connections(mesh).agg(F.sum("value"), F.min("value"), F.max("value")).first()
    assert tuple(c) == (207, 4, 19)
    assert sum(r.n for r in stats.histogram(stats.bandwidth(mesh), "value", 10).collect()) == 27


def test_surfaces(mesh):
    assert [surface.boundary(mesh, t).count() for t in (None, [1], [2])] == [48, 38, 28]
    assert [s.count() for s in surface.extract_surfaces(mesh, "1:2;1-2;1+2")] == [9, 29, 57]
    assert {r.nid for r in surface.vertices(surface.boundary(mesh)).collect()} == set(range(27)) - {13}
    shared = surface.extract_surfaces(mesh, "1:2")[0]
    assert sorted(r.nid for r in surface.vertices(shared).collect()) == [10, 11, 12, 13, 14, 15, 16, 17, 19, 21]
    assert surface.patches(mesh, surface.boundary(mesh), 45.0).select("patch").distinct().count() == 6
    n = surface.face_normals(mesh, surface.boundary(mesh)).withColumn("p", G.barycenter(F.col("pts")))
    assert n.filter(G.dot(G.vec(F.col("normal")), G.vec(F.col("p"))) <= 0).isEmpty()


def test_operation_grammar():
    assert surface.parse_operations('2,"a-b":0;1-x;3') == [(":", ["2", "a-b"], ["0"]), ("-", ["1"], ["x"]), ("", ["3"], [])]
    assert smoothing.parse_tag_sets("1,2/3", [1, 2, 3]) == [[1, 2], [3]] and smoothing.parse_tag_sets("*", [4, 5]) == [[4], [5]]


def test_submesh_and_data(mesh, spark):
    sub = select.extract_mesh(mesh, [2])
    assert [r.mesh_idx for r in sub.nod.orderBy("sub_idx").collect()] == [*range(10, 18), *range(19, 27)]
    assert [r.mesh_idx for r in sub.eidx.orderBy("sub_idx").collect()] == list(range(24, 40))
    nod, eidx = select.restore_mapping(mesh, sub.mesh)
    assert sorted(map(tuple, nod.collect())) == sorted(map(tuple, sub.nod.collect())) and sorted(map(tuple, eidx.collect())) == sorted(map(tuple, sub.eidx.collect()))
    data = mesh.nodes.select(F.col("nid").alias("idx"), (F.col("nid") * 1.5).alias("value"))
    part = attributes.extract_data(data, sub.nod)
    back = attributes.insert_data(part, sub.nod, data.select("idx"), data)
    assert back.join(data.withColumnRenamed("value", "w"), "idx").filter("value <> w").isEmpty() and back.count() == 27
    assert graph.unreachable(mesh).select("part").distinct().count() == 1


def test_gradient_of_linear_data(mesh):
    data = mesh.nodes.select(F.col("nid").alias("idx"), (F.col("x") - 2 * F.col("y") + 0.5 * F.col("z")).alias("value"))
    for nodal in (True, False):
        for r in attributes.extract_gradient(mesh, data, nodal).collect():
            assert (r.gx, r.gy, r.gz) == pytest.approx((1, -2, 0.5)) and r.magnitude == pytest.approx(math.sqrt(5.25))


def test_index_queries(mesh, spark):
    queries = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 0.0), (1, 0.0, 0.0, 0.0, 600.0), (2, -500.0, -500.0, -500.0, 0.0), (3, -500.0, 0.0, -500.0, 500.0)], "q long, x double, y double, z double, thr double")
    got = {r.q: r.ids for r in spatial.query_idxlist(mesh, queries).collect()}
    assert got == {0: [13], 1: [13, 4, 10, 12, 14, 16, 22], 2: [0], 3: [3, 0, 4, 6, 12]}


def test_eikonal_from_a_plane_is_exact(mesh):
    start = mesh.nodes.filter("x = -500").select("nid")
    got = graph.eikonal(mesh, start).join(mesh.nodes, "nid").collect()
    assert all(r.value == pytest.approx(r.x + 500) for r in got)


def test_refinement_keeps_volume(mesh):
    fine = select.uniform_refinement(mesh)
    p = [G.at(F.col("pts"), i) for i in range(4)]
    row = fine.points.agg(F.count("*"), F.sum(G.signed_tet_volume(*p)), F.min(G.signed_tet_volume(*p))).first()
    assert row[0] == 320 and row[1] == pytest.approx(1e9) and row[2] > 0


def test_refinement_keeps_other_elements(spark, mesh):
    hexahedron = spark.createDataFrame([(99, "Hx", [0, 1, 4, 3, 9, 12, 13, 10], 5, [])], mesh.elements.schema)
    both = mesh.with_elements(mesh.elements.unionByName(hexahedron))
    assert select.uniform_refinement(both).elements.filter("etype = 'Hx'").select("eid", "con").first() == (99 * 8, [0, 1, 4, 3, 9, 12, 13, 10])
    assert select.centre_refinement(both).elements.filter("etype = 'Hx'").select("eid", "tag").first() == (99 * 4, 5)


def test_merged_ids_are_dense(mesh):
    merged = select.merge_meshes(select.extract_mesh(mesh, [1]).mesh, select.extract_mesh(mesh, [1, 2]).mesh)
    assert sorted(r.nid for r in merged.nodes.collect()) == list(range(27)) and sorted(r.eid for r in merged.elements.collect()) == list(range(40))


def test_cables(spark):
    bent = [dict(x=0.0, y=0.0, z=0.0), dict(x=10.0, y=9.0, z=0.0), dict(x=100.0, y=0.0, z=0.0)]
    slow = [dict(x=0.0, y=0.0, z=0.0), dict(x=50.0, y=20.0, z=0.0), dict(x=60.0, y=-20.0, z=0.0), dict(x=100.0, y=0.0, z=0.0)]  # segments turn, directions from the start don't
    df = spark.createDataFrame([(1, bent), (2, slow)], "cid long, pts array<struct<x:double,y:double,z:double>>")
    got = smoothing.curve_resampling(df, 30.0).orderBy("cid", "pos").collect()
    assert [r.x for r in got if r.cid == 1] == [0, 10, 100] and [(r.x, r.y) for r in got if r.cid == 2] == [(0, 0), (25, 0), (50, 0), (75, 0), (100, 0)]


def test_nothing_crosses_in_a_conforming_surface(spark):
    from trellis.plans import hosts

    box = hosts.box_mesh(spark, "/root/testdata/sf0.001")
    assert stats.self_intersections(surface.surface_mesh(box, surface.boundary(box)).mesh).count() == 0
    crossing = [(0, 0.0, 0.0, 0.0), (1, 4.0, 0.0, 0.0), (2, 0.0, 4.0, 0.0), (3, 1.0, 1.0, -1.0), (4, 1.0, 1.0, 2.0), (5, 9.0, 9.0, -9.0)]
    nodes = spark.createDataFrame(crossing, box.nodes.schema)
    elements = spark.createDataFrame([(0, "Tr", [0, 1, 2], 1, []), (1, "Tr", [3, 4, 5], 1, [])], box.elements.schema)
    assert {tuple(r) for r in stats.self_intersections(type(box)(nodes, elements)).collect()} == {(3, 4, 0), (1, 2, 1)}


def test_images(spark):
    shell = [(i, j, k, 2.0) for i in (1, 2, 3) for j in (1, 2, 3) for k in (1, 2, 3) if (i, j, k) != (2, 2, 2)]
    table = spark.createDataFrame([(i + 1, j + 1, k + 1, v) for i, j, k, v in shell], "i int, j int, k int, value double")
    assert {(r.i, r.j, r.k) for r in voxels.close(voxels.Image(table, (7, 7, 7)), [2]).voxels.collect()} == {(i, j, k) for i in (2, 3, 4) for j in (2, 3, 4) for k in (2, 3, 4)}
    edge = voxels.Image(spark.createDataFrame(shell, "i int, j int, k int, value double"), (5, 5, 5))  # its dilation fills the image, and outside doesn't erode
    assert voxels.close(edge, [2]).voxels.count() == 125
    two = spark.createDataFrame([(1, 3, 3, 2.0), (3, 3, 3, 2.0), (2, 3, 3, 5.0)], "i int, j int, k int, value double")
    closed = {(r.i, r.j, r.k): r.value for r in voxels.close(voxels.Image(two, (7, 7, 7)), [2], rounds=2).voxels.collect()}
    assert closed[2, 3, 3] == 2.0 and closed[0, 3, 3] == 2.0 and (4, 3, 3) not in closed  # other tags are covered; at the border the closing grows
    far = voxels.Image(two, (7, 7, 7), spacing=(1.0, 2.0, 0.5))
    assert voxels.box(far, (1, 1, 1)) == [1, 0, 2]
    image = voxels.Image(spark.createDataFrame([(1, 1, 1, 2.0), (1, 3, 1, 2.0)], "i int, j int, k int, value double"), (5, 5, 5))
    assert voxels.crop(image).dim == (1, 3, 1) and voxels.refine(image, (2, 2, 2)).voxels.count() == 16
    assert stats.volumes(voxels.voxel_mesh(image)).agg(F.sum("value")).first()[0] == pytest.approx(2.0)


def test_series(spark):
    s = spark.createDataFrame([(t, i, float(10 * t + i)) for t in range(4) for i in range(2)], "t int, idx long, value double")
    assert series.periodic(s, 2, 0).agg(F.max("t")).first()[0] == 6
    assert {(r.t, r.value) for r in series.extend(s, 6).filter("idx = 0 and t >= 3").collect()} == {(3, 30.0), (4, 30.0), (5, 30.0)}
    fine = {r.t: r.value for r in series.refine_time(s, 2).filter("idx = 1").collect()}
    assert fine[3] == pytest.approx(16.0) and len(fine) == 7
    late = spark.createDataFrame([(t, 7, float(y)) for t, y in zip((2, 3, 4, 5, 6), (1, 4, -2, 0, 3))], "t int, idx long, value double")
    got = {r.t: r.value for r in series.refine_time(late, 4).collect()}
    slope = {r.t: r.value for r in series.refine_time(late, 4, derivative=True).collect()}
    assert sorted(got) == list(range(8, 25)) and [got[4 * t] for t in (2, 3, 4, 5, 6)] == pytest.approx([1, 4, -2, 0, 3])
    assert slope[8] == pytest.approx(0, abs=1e-12) and slope[24] == pytest.approx(0, abs=1e-12)
    x = np.arange(5.0)
    a = np.diag([2.0, 4, 4, 4, 2]) + np.diag(np.ones(4), 1) + np.diag(np.ones(4), -1)
    m = np.linalg.solve(a, 6 * np.diff([0, *np.diff([1, 4, -2, 0, 3]), 0]))
    half = [(y0 + y1) / 2 - (m0 + m1) / 16 for y0, y1, m0, m1 in zip((1, 4, -2, 0), (4, -2, 0, 3), m, m[1:])]
    assert [got[8 + 4 * int(i) + 2] for i in x[:4]] == pytest.approx(half)
    with pytest.raises(ValueError, match="steps"):
        series.steps_equal(s, s.filter("t < 2"))


def test_radii_of_many_sizes(spark):
    rng = np.random.default_rng(4)
    nodes = [(i, *map(float, p)) for i, p in enumerate(rng.random((250, 3)))]
    radii = [0.0, 1e-7, 0.02, 0.05, 0.0625, 0.25, 0.25, 1.0, 2.0, None]
    queries = [(k, *(nodes[k][1:] if k < 3 else map(float, rng.random(3))), radii[k]) for k in range(len(radii))]
    df = spark.createDataFrame(queries, "q long, x double, y double, z double, r double")
    cloud = spark.createDataFrame(nodes, "nid long, x double, y double, z double")
    near = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    want = {(q, n) for q, *p, r in queries if r is not None for n, *at in nodes if near(p, at) <= r * r}
    got = [(r.q, r.nid) for r in spatial.within(df, "q", cloud, "r").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert spatial.within(df, "q", cloud.filter("false"), "r").count() == 0
    assert spatial.within(df.filter("false"), "q", cloud, "r").count() == 0
    assert {(r.q, r.nid) for r in spatial.within(df, "q", cloud, 0.25).collect()} == {(q, n) for q, *p, _ in queries for n, *at in nodes if near(p, at) <= 0.0625}


def test_lookup_table(spark):
    rng = np.random.default_rng(5)
    x = np.sort(rng.random(300))
    y = rng.random(300)
    at = np.concatenate((rng.random(500) * 3 - 1, x[:20], [0.5] * 300))
    table = spark.createDataFrame(list(zip(x.tolist(), y.tolist())), "x double, y double")
    points = spark.createDataFrame([*enumerate(at.tolist()), (9999, None)], "idx long, x double")
    got = {r.idx: r.value for r in interpolation.piecewise_linear(points, table).collect()}
    assert got.pop(9999) is None and len(got) == len(at)
    assert np.allclose([got[i] for i in range(len(at))], np.interp(at, x, y))
    few = interpolation.piecewise_linear(points, table.limit(1)).filter("idx < 9999").select("value").distinct().collect()
    assert [r.value for r in few] == [table.first().y]
    assert interpolation.piecewise_linear(points, table.filter("false")).filter("value is not null").count() == 0
    assert interpolation.piecewise_linear(points.filter("false"), table).count() == 0
