import pytest
from fixtures import block
from pyspark.sql import functions as F

from trellis.sources import meshio
from trellis.streaming import replay


def rows(mesh, fib=True):
    e = mesh.elements.select("eid", "etype", "con", "tag", *(["fib"] if fib else []))
    return sorted(map(tuple, mesh.nodes.select("nid", "x", "y", "z").collect())), sorted((tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in e.collect()))


@pytest.mark.parametrize(("name", "fmt"), [("m", "text"), ("m", "binary"), ("m.vtk", None), ("m.vtu", None)])
def test_mesh_round_trip(spark, tmp_path, name, fmt):
    mesh = block(spark)
    meshio.write_mesh(mesh, f"{tmp_path}/{name}", fmt)
    assert rows(meshio.read_mesh(spark, f"{tmp_path}/{name}", fmt)) == rows(mesh)


def test_hexahedra_keep_their_order_through_vtk(spark, tmp_path):
    mesh = block(spark)
    hexa = mesh.with_elements(spark.createDataFrame([(0, "Hx", [0, 1, 4, 3, 9, 12, 13, 10], 3, [1.0, 0.0, 0.0]), (1, "Pr", [0, 1, 3, 9, 12, 10], 4, [1.0, 0.0, 0.0])], mesh.elements.schema))
    meshio.write_mesh(hexa, f"{tmp_path}/h.vtk")
    assert rows(meshio.read_mesh(spark, f"{tmp_path}/h.vtk")) == rows(hexa)


def test_companions(spark, tmp_path):
    data = spark.createDataFrame([(0, 0.5), (1, 2.0), (2, -1e-3)], "idx long, value double")
    meshio.write_data(data, f"{tmp_path}/d.dat")
    assert sorted(map(tuple, meshio.read_data(spark, f"{tmp_path}/d.dat").collect())) == sorted(map(tuple, data.collect()))
    mapping = spark.createDataFrame([(0, 7), (1, 3)], "sub_idx long, mesh_idx long")
    meshio.write_index(mapping, f"{tmp_path}/m.nod")
    assert sorted(map(tuple, meshio.read_index(spark, f"{tmp_path}/m.nod").collect())) == [(0, 7), (1, 3)]
    meshio.write_vtx(spark.createDataFrame([(5,), (2,)], "nid long"), f"{tmp_path}/a.vtx")
    assert sorted(r.nid for r in meshio.read_vtx(spark, f"{tmp_path}/a.vtx").collect()) == [2, 5]
    series = data.select(F.lit(0).alias("t"), "idx", "value").unionByName(data.select(F.lit(1).alias("t"), "idx", F.lit(4.0).alias("value")))
    meshio.write_igb(series, f"{tmp_path}/s.igb")
    got = meshio.read_igb(spark, f"{tmp_path}/s.igb").orderBy("t", "idx").collect()
    assert [(r.t, r.idx) for r in got] == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 2)] and got[1].value == [2.0]
    (tmp_path / "q.txt").write_text("2\n1 2 3 0\n4 5 6 7.5\n")
    assert sorted(map(tuple, meshio.read_queries(spark, f"{tmp_path}/q.txt").collect())) == [(0, 1.0, 2.0, 3.0, 0.0), (1, 4.0, 5.0, 6.0, 7.5)]


def test_image_round_trip(spark, tmp_path):
    from trellis.operators.voxels import Image

    image = Image(spark.createDataFrame([(i, j, k, float(i + 2 * j + 4 * k)) for i in range(2) for j in range(3) for k in range(2)], "i int, j int, k int, value double"), (2, 3, 2), (1.0, 2.0, 3.0), (0.5, 1.0, 2.0))
    meshio.write_image(image, f"{tmp_path}/i.vtk")
    back = meshio.read_image(spark, f"{tmp_path}/i.vtk")
    assert (back.dim, back.origin, back.spacing) == (image.dim, image.origin, image.spacing)
    assert sorted(map(tuple, back.voxels.collect())) == sorted(map(tuple, image.voxels.collect()))


def test_parsers():
    points, cells = meshio.parse_medit(b"MeshVersionFormatted 2\nDimension 3\nVertices\n4\n0 0 0 1\n1 0 0 1\n0 1 0 1\n0 0 1 1\nTetrahedra\n1\n1 2 3 4 9\nEnd\n")
    assert len(points) == 4 and cells == [("Tt", [0, 1, 2, 3], 9, [1.0, 0.0, 0.0])]
    assert meshio.parse_obj(b"v 0 0 0\nv 1 0 0\nv 0 1 0\nf 1/1/1 2//2 -1\n")[1] == [("Tr", [0, 1, 2], 0, [1.0, 0.0, 0.0])]
    assert meshio.parse_neutral(b"3\n0 0 0\n1 0 0\n0 1 0\n1\n5 1 2 3 3\n0\n")[1] == [("Tt", [0, 1, 2, 2], 5, [1.0, 0.0, 0.0])]


def test_cables_and_id_lists(spark, tmp_path):
    point = lambda *p: dict(zip("xyz", map(float, p)))
    rows = [(0, [-1, -1], [1, 2], 7.0, 100.0, 0.0006, [point(0, 0, 0), point(1.5, -2, 3)]), (1, [0, -1], [-1, -1], 7.0, 100.0, 0.5, [point(1.5, -2, 3)]), (2, [0, -1], [-1, -1], 7.0, 100.0, 0.5, [])]
    cables = spark.createDataFrame(rows, "cid long, par array<long>, br array<long>, size double, gap double, conductivity double, pts array<struct<x:double,y:double,z:double>>")
    meshio.write_cables(cables, f"{tmp_path}/p.pkje")
    assert meshio.read_cables(spark, f"{tmp_path}/p.pkje").orderBy("cid").collect() == cables.orderBy("cid").collect()
    (tmp_path / "bad.pkje").write_text("1\nCable 1\n0 0\n0 0\n0\n1\n1\n1\n")
    with pytest.raises(Exception, match="out of order"):
        meshio.read_cables(spark, f"{tmp_path}/bad.pkje").collect()
    meshio.write_id_lists(spark.createDataFrame([(1, []), (0, [13, 4])], "q int, ids array<long>"), f"{tmp_path}/ids.txt")
    assert (tmp_path / "ids.txt").read_text() == "2\n13 4 \n\n"


def test_replay(spark, tmp_path):
    for t in range(3):
        spark.createDataFrame([(t, i, float(t)) for i in range(4)], "t int, idx long, value double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/s")
    q = replay.slice_means(replay.stream_series(spark, f"{tmp_path}/s")).writeStream.outputMode("complete").format("memory").queryName("means").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("means").collect())) == [(0, 0.0, 4), (1, 1.0, 4), (2, 2.0, 4)]
