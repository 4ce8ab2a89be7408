"""The registered mesh queries and, where SQL can say it, the same in SQL.

Doubles are rounded to six places on both sides, arrays are comma strings, ids and counts BIGINT.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.functions import geometry as G
from trellis.model import Mesh, with_points
from trellis.operators import attributes, graph, interpolation, select, series, smoothing, spatial, stats, surface, voxels
from trellis.plans import hosts
from trellis.plans.hosts import CTE

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = CTE + sql
        return f

    return register


def r(c: str | Column, name: str | None = None) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    out = F.round(c, 6) + F.lit(0.0)
    return out.alias(name) if name else out


def s(c: str | Column, name: str) -> Column:
    """An array as a comma string."""
    c = F.col(c) if isinstance(c, str) else c
    return F.array_join(c.cast("array<string>"), ",").alias(name)


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(r(c, c) if kind == "double" else F.col(c).cast("long").alias(c) if kind in ("int", "bigint") else F.col(c) for c, kind in df.dtypes))


def R(c: str, name: str) -> str:  # noqa: N802
    return f"round({c}, 6) + 0.0::DOUBLE AS {name}"


# ---- selection and renumbering

_SUB = """, sub AS (SELECT * FROM oe WHERE tag IN (2, 3)), used AS (SELECT DISTINCT unnest(con) AS nid FROM sub), nod AS (SELECT nid, row_number() OVER (ORDER BY nid) - 1 AS new FROM used),
eidx AS (SELECT eid, row_number() OVER (ORDER BY eid) - 1 AS new FROM sub) """


@query(_SUB + "SELECT x.new AS eid, s.eid AS origin, s.tag, (SELECT string_agg(n.new, ',' ORDER BY o.pos) FROM oi o JOIN nod n USING (nid) WHERE o.eid = s.eid) AS con FROM sub s JOIN eidx x USING (eid)")
def extract_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    sub = select.extract_mesh(hosts.order_mesh(spark, sf_dir), [2, 3])
    return sub.mesh.elements.join(sub.eidx, F.col("eid") == F.col("sub_idx")).select("eid", F.col("mesh_idx").alias("origin"), "tag", s("con", "con"))


@query(_SUB + f"SELECT n.new AS nid, n.nid AS origin, {R('x', 'x')}, {R('y', 'y')}, {R('z', 'z')} FROM nod n JOIN onodes USING (nid)")
def extract_mesh_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sub = select.extract_mesh(hosts.order_mesh(spark, sf_dir), [2, 3])
    return rounded(sub.mesh.nodes.join(sub.nod, F.col("nid") == F.col("sub_idx")).select("nid", F.col("mesh_idx").alias("origin"), "x", "y", "z"))


@query(_SUB + f"SELECT n.new AS idx, {R('(n.nid * 37) % 101 / 10.0::DOUBLE', 'value')} FROM nod n")
def extract_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    mesh = hosts.order_mesh(spark, sf_dir)
    return rounded(attributes.extract_data(hosts.nodal_data(mesh), select.extract_mesh(mesh, [2, 3]).nod))


@query("SELECT eid, tag, array_to_string(con, ',') AS con FROM be WHERE tag <> 4")
def extract_myocard(spark: SparkSession, sf_dir: str) -> DataFrame:
    sub = select.extract_myocard(hosts.box_mesh(spark, sf_dir))
    lifted = sub.mesh.e2n.join(sub.nod, F.col("nid") == F.col("sub_idx")).groupBy("eid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "mesh_idx"))), lambda p: p["mesh_idx"]).alias("con"))
    return lifted.join(sub.mesh.elements.select("eid", "tag"), "eid").join(sub.eidx, F.col("eid") == F.col("sub_idx")).select(F.col("mesh_idx").alias("eid"), "tag", s("con", "con"))


_BOX = "SELECT eid, con FROM bp, base WHERE (x0 + x1 + x2 + x3) / 4 BETWEEN 1.3 AND 1.3 + n / 2 AND (y0 + y1 + y2 + y3) / 4 BETWEEN 0.4 AND 0.4 + n / 2 AND (z0 + z1 + z2 + z3) / 4 BETWEEN 0.7 AND 0.7 + n / 2"


def _box(spark: SparkSession, sf_dir: str) -> tuple:
    half = hosts.box_size(spark, sf_dir) / 2
    return hosts.box_mesh(spark, sf_dir), (1.3, 0.4, 0.7), (half,) * 3


@query(f"SELECT eid AS origin FROM ({_BOX})")
def extract_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.extract_volume(*_box(spark, sf_dir)).eidx.select(F.col("mesh_idx").alias("origin"))


@query(f"SELECT DISTINCT unnest(con) AS nid FROM ({_BOX})")
def extract_volume_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.volume_vertices(*_box(spark, sf_dir))


@query("SELECT eid AS idx, CAST(tag AS DOUBLE) AS value FROM be")
def extract_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.extract_tags(hosts.box_mesh(spark, sf_dir))


@query("SELECT eid, i // 3 AS part FROM be WHERE i % 3 <> 2")
def extract_unreachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.unreachable(hosts.box_mesh(spark, sf_dir, F.col("i") % 3 != 2))


@query("SELECT DISTINCT eid FROM oi WHERE nid % 50 = 7")
def vertices_to_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    mesh = hosts.order_mesh(spark, sf_dir)
    return select.vertices_to_mesh(mesh, mesh.nodes.filter("nid % 50 = 7").select("nid")).eidx.select(F.col("mesh_idx").alias("eid"))


@query("""SELECT DISTINCT eid FROM bi WHERE nid IN (SELECT b.nid FROM bi a JOIN bi b USING (eid) WHERE a.nid = 0) """)
def grow_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    mesh = hosts.box_mesh(spark, sf_dir)
    return graph.grow_layers(mesh, mesh.nodes.filter("nid = 0"), 2)


@query("SELECT eid, tag, CASE WHEN tag IN (1, 4) THEN '0.0,0.0,0.0,0.0,0.0,0.0' ELSE '1.0,0.0,0.0,0.0,1.0,0.0' END AS fib FROM oe")
def generate_fibres(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.generate_fibres(hosts.order_mesh(spark, sf_dir), [1, 4]).elements.select("eid", "tag", s("fib", "fib"))


@query(f"""SELECT nid, {R('x', 'x')}, {R('y', 'y')}, {R('z', 'z')} FROM (SELECT CAST(c AS BIGINT) AS nid, CASE WHEN c % 2 = 1 THEN mx + dx * 0.25 ELSE mx - dx * 0.25 END + 0 AS x, CASE WHEN c // 2 % 2 = 1 THEN my + dy * 0.25 ELSE my - dy * 0.25 END AS y,
CASE WHEN c // 4 = 1 THEN mz + dz * 0.25 ELSE mz - dz * 0.25 END AS z FROM range(8) t(c), (SELECT (min(x) + max(x)) / 2 AS mx, max(x) - min(x) AS dx, (min(y) + max(y)) / 2 AS my, max(y) - min(y) AS dy, (min(z) + max(z)) / 2 AS mz, max(z) - min(z) AS dz FROM onodes))""")
def generate_bboxmesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(select.bbox_mesh(hosts.order_mesh(spark, sf_dir).nodes, 0.5).nodes)


_SPLIT = """, shared AS (SELECT DISTINCT nid FROM bi WHERE tag IN (1, 3) INTERSECT SELECT DISTINCT nid FROM bi WHERE tag IN (2, 4)),
fresh AS (SELECT nid, (SELECT max(nid) + 1 FROM bn) + row_number() OVER (ORDER BY nid) - 1 AS new FROM shared), spl AS (SELECT eid AS elem, nid AS old, new FROM bi JOIN fresh USING (nid) WHERE tag IN (2, 4)) """


@query(_SPLIT + "SELECT elem, old, new FROM spl")
def generate_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.split_list(hosts.box_mesh(spark, sf_dir), [1, 3], [2, 4])


@query(_SPLIT + "SELECT b.eid, string_agg(coalesce(new, nid), ',' ORDER BY pos) AS con FROM bi b LEFT JOIN spl ON elem = eid AND old = nid GROUP BY b.eid")
def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    mesh = hosts.box_mesh(spark, sf_dir)
    return select.split_at(mesh, select.split_list(mesh, [1, 3], [2, 4])).elements.select("eid", s("con", "con"))


@query(_SPLIT + "SELECT elem, old, new FROM spl")
def generate_surfsplit(spark: SparkSession, sf_dir: str) -> DataFrame:
    mesh = hosts.box_mesh(spark, sf_dir)
    cutting = surface.intersection(surface.boundary(mesh, [2, 4]), surface.boundary(mesh, [1, 3]))
    return surface.split_list(mesh, cutting)


@query("SELECT eid, CASE WHEN tag IN (2, 3) THEN 100 + tag ELSE tag END AS tag FROM oe")
def insert_submesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    mesh = hosts.order_mesh(spark, sf_dir)
    sub = select.extract_mesh(mesh, [2, 3])
    changed = select.Submesh(sub.mesh.with_elements(sub.mesh.elements.withColumn("tag", F.col("tag") + 100)), sub.nod, sub.eidx)
    return select.insert_submesh(mesh, changed).elements.select("eid", "tag")


@query(_SUB + f"SELECT o.nid AS idx, {R('CASE WHEN n.new IS NOT NULL THEN n.new * 0.5::DOUBLE ELSE (o.nid * 37) % 101 / 10.0::DOUBLE END', 'value')} FROM onodes o LEFT JOIN nod n USING (nid)")
def insert_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    mesh = hosts.order_mesh(spark, sf_dir)
    nod = select.extract_mesh(mesh, [2, 3]).nod
    new = nod.select(F.col("sub_idx").alias("idx"), (F.col("sub_idx") * 0.5).alias("value"))
    return rounded(attributes.insert_data(new, nod, mesh.nodes.select(F.col("nid").alias("idx")), hosts.nodal_data(mesh)))


@query("SELECT eid, CASE WHEN eid % 3 = 0 THEN eid % 7 ELSE tag END AS tag FROM oe")
def insert_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    mesh = hosts.order_mesh(spark, sf_dir)
    tags = mesh.elements.filter("eid % 3 = 0").select(F.col("eid").alias("idx"), (F.col("eid") % 7).cast("double").alias("value"))
    return select.insert_tags(mesh, tags).elements.select("eid", "tag")


@query(_SUB + "SELECT coalesce(n.new, -1) AS idx, count(*) AS n FROM oi LEFT JOIN nod n USING (nid) GROUP BY 1")
def map_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    mesh = hosts.order_mesh(spark, sf_dir)
    lists = mesh.e2n.select(F.col("nid").alias("idx"))
    return select.map_ids(lists, select.extract_mesh(mesh, [2, 3]).nod, "m2s", keep=True).groupBy("idx").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT nid AS mesh_idx FROM bi WHERE tag IN (2, 3)")
def restore_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    mesh = hosts.box_mesh(spark, sf_dir)
    return select.restore_mapping(mesh, select.extract_mesh(mesh, [2, 3]).mesh)[0].select("mesh_idx")


@query("SELECT eid AS mesh_idx FROM be WHERE tag IN (2, 3)")
def restore_mapping_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    mesh = hosts.box_mesh(spark, sf_dir)
    return select.restore_mapping(mesh, select.extract_mesh(mesh, [2, 3]).mesh)[1].select("mesh_idx")


@query("SELECT count(DISTINCT con) AS n_elements, (SELECT count(*) FROM bn) AS n_nodes, count(DISTINCT CASE WHEN tag = 1 THEN con END) AS n_tag1 FROM be")
def merge_meshes(spark: SparkSession, sf_dir: str) -> DataFrame:
    mesh = hosts.box_mesh(spark, sf_dir)
    merged = select.merge_meshes(select.extract_mesh(mesh, [1, 2, 3]).mesh, select.extract_mesh(mesh, [2, 3, 4]).mesh)
    return merged.elements.agg(F.count("*").alias("n_elements"), F.count_if(F.col("tag") == 1).alias("n_tag1")).crossJoin(merged.nodes.agg(F.count("*").alias("n_nodes")))


_TOPOLOGY = """, k AS (SELECT nid, max(nid) OVER (PARTITION BY CAST(trunc(x) AS BIGINT), CAST(trunc(y) AS BIGINT), CAST(trunc(z) AS BIGINT)) AS "to" FROM snodes),
c AS (SELECT eid, tag, list("to" ORDER BY pos) AS con FROM si JOIN k USING (nid) GROUP BY eid, tag HAVING count(DISTINCT "to") = 4), u AS (SELECT min(eid) AS eid FROM c GROUP BY list_sort(con)),
p AS (SELECT c.eid, c.con, a.x AS x0, a.y AS y0, a.z AS z0, b.x AS x1, b.y AS y1, b.z AS z1, d.x AS x2, d.y AS y2, d.z AS z2, e.x AS x3, e.y AS y3, e.z AS z3 FROM c JOIN u USING (eid)
JOIN snodes a ON a.nid = con[1] JOIN snodes b ON b.nid = con[2] JOIN snodes d ON d.nid = con[3] JOIN snodes e ON e.nid = con[4])
SELECT eid, array_to_string(con, ',') AS con FROM p WHERE ((y1 - y0) * (z2 - z0) - (z1 - z0) * (y2 - y0)) * (x3 - x0) + ((z1 - z0) * (x2 - x0) - (x1 - x0) * (z2 - z0)) * (y3 - y0) + ((x1 - x0) * (y2 - y0) - (y1 - y0) * (x2 - x0)) * (z3 - z0) <> 0"""


@query(_TOPOLOGY)
def clean_topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    mesh = hosts.supplier_mesh(spark, sf_dir)
    return select.drop_flat_elements(select.drop_duplicate_elements(select.merge_duplicate_vertices(mesh, 1.0))).elements.select("eid", s("con", "con"))


@query("SELECT eid, array_to_string(con, ',') AS con FROM be")
def convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second element is turned inside out first (nodes 0 and 2 change places); converting turns it back."""
    mesh = hosts.box_mesh(spark, sf_dir)
    c = F.col("con")
    turned = mesh.with_elements(mesh.elements.withColumn("con", F.when(F.col("eid") % 2 == 0, F.array(c[2], c[1], c[0], c[3])).otherwise(c)))
    return select.convert(turned, 2.0).elements.select("eid", s("con", "con"))


@query(f"SELECT nid, {R('(mx - (y - my) + 1.0) * 3.0', 'x')}, {R('(my + (x - mx) - 2.0) * 3.0', 'y')}, {R('(z + 0.5) * 3.0', 'z')} FROM bn, (SELECT (min(x) + max(x)) / 2 AS mx, (min(y) + max(y)) / 2 AS my FROM bn)")
def transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(select.transform(hosts.box_mesh(spark, sf_dir), (0, 0, 90), (1.0, -2.0, 0.5), 3.0).nodes)


@query("SELECT count(*) * 8 AS n_elements, (SELECT count(*) FROM bn) + (SELECT count(*) FROM (SELECT DISTINCT v1, v2 FROM bpair)) AS n_nodes, round(sum(v6) / 6, 4) + 0.0::DOUBLE AS total, min(eid) * 8 AS first FROM bv")
def refine_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    fine = select.uniform_refinement(hosts.box_mesh(spark, sf_dir))
    p = [G.at(F.col("pts"), i) for i in range(4)]
    return fine.points.agg(F.count("*").alias("n_elements"), (F.round(F.sum(F.abs(G.signed_tet_volume(*p))), 4) + F.lit(0.0)).alias("total"), F.min("eid").alias("first")).crossJoin(fine.nodes.agg(F.count("*").alias("n_nodes")))


@query("SELECT count(*) * 4 AS n_elements, (SELECT count(*) FROM bn) + count(*) AS n_nodes, round(sum(v6) / 6, 4) + 0.0::DOUBLE AS total FROM bv")
def refine_centre(spark: SparkSession, sf_dir: str) -> DataFrame:
    fine = select.centre_refinement(hosts.box_mesh(spark, sf_dir))
    p = [G.at(F.col("pts"), i) for i in range(4)]
    return fine.points.agg(F.count("*").alias("n_elements"), (F.round(F.sum(G.signed_tet_volume(*p)), 4) + F.lit(0.0)).alias("total")).crossJoin(fine.nodes.agg(F.count("*").alias("n_nodes")))


@query(f"SELECT v1, v2, {R('len2', 'len2')}, CASE WHEN len2 > 2.25::DOUBLE THEN 'split' ELSE 'collapse' END AS op FROM blen WHERE len2 > 2.25::DOUBLE OR len2 < 1.0::DOUBLE")
def resample_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(select.edge_selection(hosts.box_mesh(spark, sf_dir), 1.0, 1.5))


@query()
def resample_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume is kept and no edge is longer than the limit; which edges are cut depends on the rounds, so there is no SQL."""
    fine = select.resample(hosts.box_mesh(spark, sf_dir), 1.6)
    p = [G.at(F.col("pts"), i) for i in range(4)]
    longest = stats.longest_edge(F.col("etype"), F.col("pts"))
    return rounded(fine.points.agg(F.count("*").alias("n_elements"), F.sum(G.signed_tet_volume(*p)).alias("total"), F.max(longest).alias("longest")))


# ---- surfaces

@query("SELECT array_to_string(fkey, ',') AS fkey, eid, tag, array_to_string(face, ',') AS face FROM bs")
def extract_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surface.boundary(hosts.box_mesh(spark, sf_dir)).select(s("fkey", "fkey"), "eid", "tag", s("face", "face"))


_ODD = "SELECT fkey, max(eid) AS eid FROM sf WHERE tag IN ({}) GROUP BY fkey HAVING count(*) % 2 = 1"


@query(f""", a AS ({_ODD.format('1, 2')}), b AS ({_ODD.format('3')}) SELECT op, array_to_string(fkey, ',') AS fkey, eid FROM (SELECT 'and' AS op, * FROM a WHERE fkey IN (SELECT fkey FROM b)
UNION ALL SELECT 'minus', * FROM a WHERE fkey NOT IN (SELECT fkey FROM b) UNION ALL SELECT 'plus', * FROM a UNION ALL SELECT 'plus', * FROM b WHERE fkey NOT IN (SELECT fkey FROM a))""")
def extract_surface_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = surface.extract_surfaces(hosts.supplier_mesh(spark, sf_dir), "1,2:3;1,2-3;1,2+3")
    out = None
    for name, part in zip(("and", "minus", "plus"), parts):
        rows = part.select(F.lit(name).alias("op"), s("fkey", "fkey"), "eid")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("SELECT DISTINCT unnest(face) AS nid FROM bs")
def surface_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surface.vertices(surface.boundary(hosts.box_mesh(spark, sf_dir)))


@query("SELECT s.eid, s.tag, array_to_string(face, ',') AS face, list_filter(con, lambda x: NOT list_contains(face, x))[1] AS sp_vtx FROM bs s JOIN be USING (eid)")
def surface_neumann(spark: SparkSession, sf_dir: str) -> DataFrame:
    mesh = hosts.box_mesh(spark, sf_dir)
    return surface.neumann(mesh, surface.boundary(mesh)).select("eid", "tag", s("face", "face"), "sp_vtx")


_RING = """, ring AS (SELECT fkey, eid, tag, unnest([[face[1], face[2]], [face[2], face[3]], [face[3], face[1]]]) AS e FROM {0}), edges AS (SELECT list_min(e) AS v1, list_max(e) AS v2, fkey, eid FROM ring) """
_BS1 = ", t1 AS (SELECT fkey, max_by(eid, eid * 4 + fpos) AS eid, max_by(tag, eid * 4 + fpos) AS tag, max_by(face, eid * 4 + fpos) AS face FROM bf WHERE tag = 1 GROUP BY fkey HAVING count(*) % 2 = 1), t1o AS (SELECT * FROM t1 WHERE fkey IN (SELECT fkey FROM bs))"


@query(_BS1 + _RING.format("t1o") + "SELECT DISTINCT unnest([v1, v2]) AS nid FROM (SELECT v1, v2 FROM edges GROUP BY v1, v2 HAVING count(*) = 1)")
def surface_border(spark: SparkSession, sf_dir: str) -> DataFrame:
    mesh = hosts.box_mesh(spark, sf_dir)
    return surface.border_nodes(surface.intersection(surface.boundary(mesh, [1]), surface.boundary(mesh)))


@query(_RING.format("(SELECT fkey, max(eid) AS eid, 0 AS tag, fkey AS face FROM sf GROUP BY fkey HAVING count(*) % 2 = 1)") + "SELECT v1, v2 FROM edges GROUP BY v1, v2 HAVING count(*) > 2")
def surface_line_interfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    mesh = hosts.supplier_mesh(spark, sf_dir)
    return surface.line_interfaces(mesh, surface.boundary(mesh))


# outward normals of boundary faces: the faces are clockwise from outside
_NORMAL = """, fn AS (SELECT *, (qy * pz - qz * py) AS nx, (qz * px - qx * pz) AS ny, (qx * py - qy * px) AS nz FROM (SELECT s.*, b.x - a.x AS px, b.y - a.y AS py, b.z - a.z AS pz, c.x - a.x AS qx, c.y - a.y AS qy, c.z - a.z AS qz
FROM bs s JOIN bn a ON a.nid = face[1] JOIN bn b ON b.nid = face[2] JOIN bn c ON c.nid = face[3])), un AS (SELECT fkey, eid, face, nx / l AS nx, ny / l AS ny, nz / l AS nz, l / 2 AS area FROM (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS l FROM fn)) """


@query(_NORMAL + f"SELECT array_to_string(fkey, ',') AS fkey, {R('nx', 'nx')}, {R('ny', 'ny')}, {R('nz', 'nz')}, {R('area', 'area')} FROM un")
def surface_face_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    mesh = hosts.box_mesh(spark, sf_dir)
    return rounded(surface.face_normals(mesh, surface.boundary(mesh)).select(s("fkey", "fkey"), *(F.col(f"normal.{c}").alias(f"n{c}") for c in "xyz"), "area"))


@query(_NORMAL + _RING.format("(SELECT *, 0 AS tag FROM un)") + """, en AS (SELECT v1, v2, un.eid, un.fkey, nx, ny, nz FROM edges JOIN un USING (fkey)),
first AS (SELECT v1, v2, min_by({'x': nx, 'y': ny, 'z': nz}, {'e': eid, 'f': fkey}) AS f FROM en GROUP BY v1, v2) SELECT v1, v2 FROM en JOIN first USING (v1, v2) GROUP BY v1, v2 HAVING min(abs(f.x * nx + f.y * ny + f.z * nz)) < cos(radians(45))""")
def surface_sharp_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    mesh = hosts.box_mesh(spark, sf_dir)
    return surface.sharp_edges(mesh, surface.boundary(mesh), 45.0)


@query()
def surface_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six sides of the box, found by flooding that stops at sharp edges."""
    mesh = hosts.box_mesh(spark, sf_dir)
    return surface.patches(mesh, surface.boundary(mesh), 45.0).groupBy("patch").agg(F.count("*").alias("n"))


@query()
def surface_by_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    mesh = hosts.box_mesh(spark, sf_dir)
    half = hosts.box_size(spark, sf_dir) / 2
    return surface.restrict_by_seeds(mesh, surface.boundary(mesh), [(half, half, -1.0)], edge=45.0).select(s("fkey", "fkey"), "eid")


@query(_NORMAL + f""", vn AS (SELECT unnest(face) AS nid, eid, fkey, nx, ny, nz FROM un), f AS (SELECT nid, min_by({{'x': nx, 'y': ny, 'z': nz}}, {{'e': eid, 'f': fkey}}) AS f FROM vn GROUP BY nid),
m AS (SELECT nid, greatest(min(f.x * nx + f.y * ny + f.z * nz), 0.0) AS value FROM vn JOIN f USING (nid) GROUP BY nid) SELECT nid, {R('least(coalesce(value, 0.0), 1.0)', 'value')} FROM bn LEFT JOIN m USING (nid)""")
def query_smoothness(spark: SparkSession, sf_dir: str) -> DataFrame:
    mesh = hosts.box_mesh(spark, sf_dir)
    return rounded(surface.smoothness(mesh, surface.boundary(mesh)))


@query(_NORMAL + f""", c AS (SELECT un.*, unnest([1, 2, 3]) AS q FROM un), p AS (SELECT face[q] AS nid, face[q % 3 + 1] AS nb, face[(q + 1) % 3 + 1] AS nc, nx, ny, nz FROM c),
w AS (SELECT p.*, b.x - a.x AS ux, b.y - a.y AS uy, b.z - a.z AS uz, c.x - a.x AS vx, c.y - a.y AS vy, c.z - a.z AS vz FROM p JOIN bn a ON a.nid = p.nid JOIN bn b ON b.nid = nb JOIN bn c ON c.nid = nc),
g AS (SELECT nid, nx, ny, nz, atan2(sqrt((uy * vz - uz * vy) * (uy * vz - uz * vy) + (uz * vx - ux * vz) * (uz * vx - ux * vz) + (ux * vy - uy * vx) * (ux * vy - uy * vx)), ux * vx + uy * vy + uz * vz) AS a FROM w),
t AS (SELECT nid, sum(nx * a) AS x, sum(ny * a) AS y, sum(nz * a) AS z FROM g GROUP BY nid) SELECT nid, {R('x / sqrt(x * x + y * y + z * z)', 'x')}, {R('y / sqrt(x * x + y * y + z * z)', 'y')}, {R('z / sqrt(x * x + y * y + z * z)', 'z')} FROM t""")
def query_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    mesh = hosts.box_mesh(spark, sf_dir)
    return rounded(surface.nodal_normals(mesh, surface.boundary(mesh)))


@query()
def query_curvature(spark: SparkSession, sf_dir: str) -> DataFrame:
    mesh = hosts.box_mesh(spark, sf_dir)
    return rounded(surface.curvature(mesh, surface.boundary(mesh), 2))


@query("SELECT eid, array_to_string(list_reverse(face), ',') AS con, tag FROM bs")
def surface_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    mesh = hosts.box_mesh(spark, sf_dir)
    owner = surface.boundary(mesh).select("eid", F.reverse("face").alias("want"))
    sub = surface.surface_mesh(mesh, surface.boundary(mesh))
    lifted = sub.mesh.e2n.join(sub.nod, F.col("nid") == F.col("sub_idx")).groupBy(F.col("eid").alias("sid")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "mesh_idx"))), lambda p: p["mesh_idx"]).alias("con"))
    return lifted.join(sub.mesh.elements.select(F.col("eid").alias("sid"), "tag"), "sid").join(owner, F.col("con") == F.col("want")).select("eid", s("con", "con"), "tag")


@query("SELECT eid, array_to_string(list_reverse(face), ',') AS face FROM bs")
def clean_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second boundary face is turned the wrong way first; all must then point outwards (counter-clockwise from outside here)."""
    mesh = hosts.box_mesh(spark, sf_dir)
    rows = surface.boundary(mesh).withColumn("face", F.when(F.col("eid") % 2 == 0, F.reverse("face")).otherwise(F.col("face")))
    return surface.orient(rows, mesh).select("eid", s(F.reverse("face"), "face"))


# ---- statistics

@query("SELECT tag, CASE WHEN tag = 4 THEN 'bath' ELSE 'myocard' END AS kind FROM (SELECT DISTINCT tag FROM be)")
def query_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.query_tags(hosts.box_mesh(spark, sf_dir))


@query("SELECT " + ", ".join(f"{R(f'min({c})', f'min_{c}')}, {R(f'max({c})', f'max_{c}')}, {R(f'max({c}) - min({c})', f'd_{c}')}" for c in "xyz") + " FROM onodes")
def query_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(select.bbox(hosts.order_mesh(spark, sf_dir).nodes))


@query("SELECT nid, CAST(count(*) AS DOUBLE) AS value FROM (SELECT DISTINCT a.nid, b.nid AS nbr FROM oi a JOIN oi b USING (eid)) GROUP BY nid")
def query_edges_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.connections(hosts.order_mesh(spark, sf_dir))


@query("SELECT a.nid, b.nid AS nbr, count(*) AS n FROM bi a JOIN bi b USING (eid) GROUP BY a.nid, b.nid HAVING count(*) >= 4")
def restrict_connectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.shared_elements(hosts.box_mesh(spark, sf_dir), 4)


@query(f"SELECT p.nid, {R('sqrt(pow(avg(q.x) - p.x, 2) + pow(avg(q.y) - p.y, 2) + pow(avg(q.z) - p.z, 2))', 'value')} FROM (SELECT v1 AS nid, v2 AS nbr FROM bpair UNION ALL SELECT v2, v1 FROM bpair) e JOIN bn p ON p.nid = e.nid JOIN bn q ON q.nid = e.nbr GROUP BY p.nid, p.x, p.y, p.z")
def distance_to_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.distance_to_centroid(hosts.box_mesh(spark, sf_dir)))


@query(f", c AS (SELECT avg(x) AS x, avg(y) AS y, avg(z) AS z FROM bn) SELECT {R('c.x', 'x')}, {R('c.y', 'y')}, {R('c.z', 'z')}, {R('max(sqrt(pow(bn.x - c.x, 2) + pow(bn.y - c.y, 2) + pow(bn.z - c.z, 2)))', 'radius')} FROM bn, c GROUP BY c.x, c.y, c.z")
def bounding_sphere(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.bounding_sphere(hosts.box_mesh(spark, sf_dir).nodes))


@query("SELECT row_number() OVER (ORDER BY v1, v2) - 1 AS eid, CAST(v1 AS VARCHAR) || ',' || CAST(v2 AS VARCHAR) AS con FROM bpair")
def edge_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.edge_mesh(hosts.box_mesh(spark, sf_dir)).elements.select("eid", s("con", "con"))


@query(f"SELECT array_to_string(fkey, ',') AS fkey, {R('((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x)) / 2.0', 'value')} FROM bs JOIN bn a ON a.nid = face[1] JOIN bn b ON b.nid = face[2] JOIN bn c ON c.nid = face[3]")
def signed_triangle_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    mesh = hosts.box_mesh(spark, sf_dir)
    faces = with_points(surface.boundary(mesh), "face", "fkey", mesh.nodes)
    p = [G.at(F.col("pts"), i) for i in range(3)]
    return rounded(faces.select(s("fkey", "fkey"), G.signed_triangle_area(*p).alias("value")))


_OLEN = ", pr AS (SELECT DISTINCT a.nid AS v1, b.nid AS v2 FROM oi a JOIN oi b ON a.eid = b.eid AND a.nid < b.nid), ol AS (SELECT sqrt((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y) + (q.z - p.z) * (q.z - p.z)) AS value FROM pr JOIN onodes p ON p.nid = v1 JOIN onodes q ON q.nid = v2) "


@query(_OLEN + f"SELECT count(*) AS n, round(sum(value), 3) + 0.0::DOUBLE AS total, {R('avg(value)', 'mean')}, {R('stddev_samp(value)', 'sd')}, {R('min(value)', 'lo')}, {R('max(value)', 'hi')} FROM ol")
def query_edges_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = rounded(stats.summary(stats.lengths(hosts.order_mesh(spark, sf_dir)), "value"))
    return df.withColumn("total", F.round("total", 3) + F.lit(0.0))


def _hist(rows: str, bins: int) -> str:
    return f""", src AS ({rows}), lim AS (SELECT min(value) AS lo, max(value) AS hi, count(*) AS total FROM src), cnt AS (SELECT CAST(floor((value - lo) / ((hi - lo) / {bins})) AS BIGINT) AS bin, count(*) AS n FROM src, lim GROUP BY 1)
SELECT b.bin, {R(f'lo + b.bin * ((hi - lo) / {bins})', 'low')}, coalesce(n, 0) AS n, {R('coalesce(n, 0) / total', 'fraction')} FROM (SELECT unnest(range({bins + 1})) AS bin) b, lim LEFT JOIN cnt ON cnt.bin = b.bin"""


@query(_hist("SELECT nid, CAST(max(nbr) - min(nbr) AS DOUBLE) AS value FROM (SELECT DISTINCT a.nid, b.nid AS nbr FROM oi a JOIN oi b USING (eid)) GROUP BY nid", 10))
def query_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.histogram(stats.bandwidth(hosts.order_mesh(spark, sf_dir)), "value", 10))


@query("SELECT CAST(floor(nid * 30 / top) AS BIGINT) AS row, CAST(floor(nbr * 60 / top) AS BIGINT) AS col, count(*) AS n FROM (SELECT DISTINCT a.nid, b.nid AS nbr FROM oi a JOIN oi b USING (eid)), (SELECT max(nid) + 1 AS top FROM onodes) GROUP BY 1, 2")
def query_graph_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.pattern(hosts.order_mesh(spark, sf_dir)))


@query(f"SELECT eid, {R('abs(v6) / 6', 'value')} FROM bv")
def query_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.volumes(hosts.box_mesh(spark, sf_dir)))


_D = lambda a, b: f"((x{a}-x{b})*(x{a}-x{b})+(y{a}-y{b})*(y{a}-y{b})+(z{a}-z{b})*(z{a}-z{b}))"
_RMS = "sqrt((" + "+".join(_D(b, a) for a in range(4) for b in range(a + 1, 4)) + ")/6.0)"
_QUALITY = f", bq AS (SELECT eid, CASE WHEN v6 <= 0 THEN 1.0::DOUBLE ELSE 1.0 - sqrt(2.0) * v6 / (rms * rms * rms) END AS value FROM (SELECT *, {_RMS} AS rms FROM bv)) "


@query(_QUALITY + f"SELECT eid, {R('value', 'value')} FROM bq")
def query_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.quality(hosts.box_mesh(spark, sf_dir)))


@query(_QUALITY + f"SELECT count(*) AS n, round(sum(value), 3) + 0.0::DOUBLE AS total, {R('avg(value)', 'mean')}, {R('stddev_samp(value)', 'sd')}, {R('min(value)', 'lo')}, {R('max(value)', 'hi')}, count(*) FILTER (value > 0.25) AS n_above FROM bq")
def query_quality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = rounded(stats.quality_summary(hosts.box_mesh(spark, sf_dir), 0.25))
    return df.withColumn("total", F.round("total", 3) + F.lit(0.0))


@query(_QUALITY + f"SELECT CAST(least(floor(value * 50), 49) AS BIGINT) AS bin, {R('count(*) / (SELECT count(*) FROM bq)', 'fraction')} FROM bq GROUP BY 1")
def query_quality_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.quality_histogram(hosts.box_mesh(spark, sf_dir)))


@query(_QUALITY + f"SELECT nid, {R('avg(value)', 'mean')}, {R('max(value)', 'worst')} FROM bi JOIN bq USING (eid) GROUP BY nid")
def query_quality_nodal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.nodal_quality(hosts.box_mesh(spark, sf_dir)))


@query()
def query_self_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    mesh = hosts.box_mesh(spark, sf_dir)
    return stats.self_intersections(surface.surface_mesh(mesh, surface.boundary(mesh)).mesh)


_SIX = "(" + "+".join(f"sqrt{_D(b, a)}" for a in range(4) for b in range(a + 1, 4)) + ")/6.0"
_LEAST = "least(" + ",".join(f"sqrt{_D(b, a)}" for a in range(4) for b in range(a + 1, 4)) + ")"


@query(f"SELECT {R(f'avg({_SIX})', 'mean')}, {R(f'min({_LEAST})', 'least')} FROM bp")
def average_edge_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.average_edge_length(hosts.box_mesh(spark, sf_dir)))


@query(f"SELECT nid, {R('avg(sqrt(len2))', 'value')} FROM (SELECT v1 AS nid, len2 FROM blen UNION ALL SELECT v2, len2 FROM blen) GROUP BY nid")
def nodal_sizing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.nodal_sizing(hosts.box_mesh(spark, sf_dir)))


# ---- attributes

@query(f"SELECT idx, {R('coalesce(v, 0)', 'value')} FROM (SELECT nid AS idx FROM bn) LEFT JOIN (SELECT nid AS idx, sum(value * abs(v6) / 6) / sum(abs(v6) / 6) AS v FROM bi JOIN bv USING (eid) JOIN bed ON bed.idx = eid GROUP BY nid) USING (idx)")
def interpolate_elem2node(spark: SparkSession, sf_dir: str) -> DataFrame:
    mesh = hosts.box_mesh(spark, sf_dir)
    return rounded(attributes.elem_to_node(mesh, hosts.element_data(mesh)))


@query(f"SELECT eid AS idx, {R('avg(value)', 'value')} FROM oi JOIN (SELECT nid, (nid * 37) % 101 / 10.0::DOUBLE AS value FROM onodes) USING (nid) GROUP BY eid")
def interpolate_node2elem(spark: SparkSession, sf_dir: str) -> DataFrame:
    mesh = hosts.order_mesh(spark, sf_dir)
    return rounded(attributes.node_to_elem(mesh, hosts.nodal_data(mesh)))


_U = {c: (f"({c}1-{c}0)", f"({c}2-{c}0)", f"({c}3-{c}0)") for c in "xyz"}


def _gradient(c: str, d: str) -> str:
    u, v, w = range(3)
    term = lambda p, q, f: f"({_U[c][p]}*{_U[d][q]}-{_U[d][p]}*{_U[c][q]})*(f{f}-f0)"
    return f"({term(v, w, 1)}+{term(w, u, 2)}+{term(u, v, 3)})/v6"


_GRADIENT = f", bg AS (SELECT eid, {_gradient('y', 'z')} AS gx, {_gradient('z', 'x')} AS gy, {_gradient('x', 'y')} AS gz, abs(v6) AS w FROM (SELECT bv.*, " + ", ".join(f"f{i}.value AS f{i}" for i in range(4)) + " FROM bv " + " ".join(f"JOIN bd f{i} ON f{i}.idx = con[{i + 1}]" for i in range(4)) + ")) "


@query(_GRADIENT + f"SELECT eid AS idx, {R('gx', 'gx')}, {R('gy', 'gy')}, {R('gz', 'gz')}, {R('sqrt(gx*gx+gy*gy+gz*gz)', 'magnitude')} FROM bg")
def extract_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    mesh = hosts.box_mesh(spark, sf_dir)
    return rounded(attributes.extract_gradient(mesh, hosts.nodal_data(mesh), nodal=False))


@query(_GRADIENT + f", ng AS (SELECT nid, sum(gx*w)/sum(w) AS gx, sum(gy*w)/sum(w) AS gy, sum(gz*w)/sum(w) AS gz FROM bi JOIN bg USING (eid) GROUP BY nid) SELECT nid AS idx, {R('gx', 'gx')}, {R('gy', 'gy')}, {R('gz', 'gz')}, {R('sqrt(gx*gx+gy*gy+gz*gz)', 'magnitude')} FROM ng")
def extract_gradient_nodal(spark: SparkSession, sf_dir: str) -> DataFrame:
    mesh = hosts.box_mesh(spark, sf_dir)
    return rounded(attributes.extract_gradient(mesh, hosts.nodal_data(mesh)))


@query("SELECT e.eid, coalesce(b.tag, e.tag) AS tag FROM (SELECT eid, 9 AS tag FROM be) e LEFT JOIN be b USING (eid)")
def insert_meshdata(spark: SparkSession, sf_dir: str) -> DataFrame:
    mesh = hosts.box_mesh(spark, sf_dir)
    blank = mesh.with_elements(mesh.elements.withColumn("tag", F.lit(9).cast("long")))
    return attributes.insert_meshdata(blank, mesh, "tags", 4).elements.select("eid", "tag")


_LINKS = ", lk AS (SELECT a.eid, b.eid AS other, count(*) AS n FROM bi a JOIN bi b ON a.nid = b.nid AND a.eid <> b.eid GROUP BY 1, 2), tg AS (SELECT eid, CASE WHEN eid % 11 = 0 THEN 7 ELSE tag END AS tag FROM be)"


@query(_LINKS + """, rw AS (SELECT lk.*, o.tag AS t, m.tag AS tag FROM lk JOIN tg o ON o.eid = other JOIN tg m ON m.eid = lk.eid), sm AS (SELECT eid, count(*) FILTER (n >= 3 AND t = tag) AS same FROM rw GROUP BY eid),
vt AS (SELECT eid, arg_max(t, v * 1000 - t) AS top FROM (SELECT eid, t, count(*) AS v FROM rw GROUP BY eid, t) GROUP BY eid) SELECT eid, CASE WHEN coalesce(same, 0) < 1 THEN coalesce(top, tag) ELSE tag END AS tag FROM tg LEFT JOIN sm USING (eid) LEFT JOIN vt USING (eid)""")
def retag(spark: SparkSession, sf_dir: str) -> DataFrame:
    mesh = hosts.box_mesh(spark, sf_dir)
    spotted = mesh.with_elements(mesh.elements.withColumn("tag", F.when(F.col("eid") % 11 == 0, 7).otherwise(F.col("tag"))))
    return attributes.retag(spotted, 1, 3, rounds=1).elements.select("eid", "tag")


@query()
def simplify_tag_topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    mesh = hosts.box_mesh(spark, sf_dir)
    spotted = mesh.with_elements(mesh.elements.withColumn("tag", F.when(F.col("eid") % 11 == 0, 7).otherwise(F.col("tag"))))
    return attributes.simplify_tags(spotted, 3).elements.select("eid", "tag")


@query("SELECT eid, CASE WHEN tag = 1 AND label = 2 THEN 20 WHEN tag = 2 AND label = 3 THEN 30 ELSE tag END AS tag FROM (SELECT b.eid, b.tag, coalesce(CAST(img.value AS BIGINT), -1) AS label FROM (SELECT eid, tag, floor((x0+x1+x2+x3)/4) AS i, floor((y0+y1+y2+y3)/4) AS j, floor((z0+z1+z2+z3)/4) AS k FROM bp) b LEFT JOIN img USING (i, j, k))")
def retag_by_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    image = hosts.lattice_image(spark, sf_dir)
    return attributes.retag_by_image(hosts.box_mesh(spark, sf_dir), image.voxels, (0.0, 0.0, 0.0), (1.0, 1.0, 1.0), {2: (1, 20), 3: (2, 30)}).elements.select("eid", "tag")


def _inner_box(spark: SparkSession, sf_dir: str, low: float = 1.37, size: float = 4.2) -> Mesh:
    """A closed triangle mesh: an axis-parallel cube with faces clockwise from outside."""
    nodes = spark.range(8).select("id", *((low + size * (F.floor(F.col("id") / b) % 2)).alias(c) for c, b in zip("xyz", (1, 2, 4))))
    return select.bbox_mesh(nodes.withColumnRenamed("id", "nid"))


_CUBE = "{0} > 1.37 AND {0} < 1.37 + 4.2 AND {1} > 1.37 AND {1} < 1.37 + 4.2 AND {2} > 1.37 AND {2} < 1.37 + 4.2"


@query(f", h AS (SELECT eid, bool_and({_CUBE.format('x', 'y', 'z')}) AS inside FROM bi JOIN bn USING (nid) GROUP BY eid) SELECT eid, CASE WHEN inside THEN 55 ELSE tag END AS tag FROM be JOIN h USING (eid)")
def sample_element_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.sample_tags(hosts.box_mesh(spark, sf_dir), _inner_box(spark, sf_dir), 55)


@query(f"SELECT nid, {_CUBE.format('x', 'y', 'z')} AS inside FROM bn")
def nodes_in_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = _inner_box(spark, sf_dir)
    faces = box.elements.select(F.col("con").alias("face"), F.array_sort("con").alias("fkey"))
    return spatial.inside_surface(hosts.box_mesh(spark, sf_dir).nodes, "nid", box, faces)


@query()
def volume_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(attributes.volume_fractions(hosts.box_mesh(spark, sf_dir), _inner_box(spark, sf_dir)))


@query()
def query_insidepoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spatial.query_insidepoint(_inner_box(spark, sf_dir)))


# ---- spatial

_Q = "(SELECT CAST(c_custkey AS BIGINT) AS q, CAST((c_custkey * 7) % 113 AS DOUBLE) / 113 * n AS x, CAST((c_custkey * 13) % 127 AS DOUBLE) / 127 * n AS y, CAST((c_custkey * 29) % 131 AS DOUBLE) / 131 * n AS z FROM customer, base)"
_D2 = "(n.x - q.x) * (n.x - q.x) + (n.y - q.y) * (n.y - q.y) + (n.z - q.z) * (n.z - q.z)"


def _points(spark: SparkSession, sf_dir: str, key: str = "q") -> DataFrame:
    n = hosts.box_size(spark, sf_dir)
    c = F.col("c_custkey").cast("long")
    return hosts.read(spark, sf_dir, "customer").select(c.alias(key), *(((c * a) % m / F.lit(float(m)) * n).alias(x) for x, a, m in (("x", 7, 113), ("y", 13, 127), ("z", 29, 131))))


@query(f"SELECT q.q, arg_min(n.nid, {{'d': {_D2}, 'n': n.nid}}) AS nid, {R(f'min({_D2})', 'dist2')} FROM {_Q} q, bn n GROUP BY q.q")
def nearest_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spatial.nearest(_points(spark, sf_dir), "q", hosts.box_mesh(spark, sf_dir).nodes))


@query(f"SELECT q, rank, nid, {R('d', 'dist2')} FROM (SELECT q.q, n.nid, {_D2} AS d, row_number() OVER (PARTITION BY q.q ORDER BY {_D2}, n.nid) AS rank FROM {_Q} q, bn n) WHERE rank <= 5")
def k_nearest_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spatial.k_nearest(_points(spark, sf_dir), "q", hosts.box_mesh(spark, sf_dir).nodes, 5))


@query(f"SELECT nid, other, {R('d', 'dist2')} FROM (SELECT q.nid, arg_min(n.nid, {{'d': {_D2}, 'n': n.nid}}) AS other, min({_D2}) AS d FROM cloud q, (SELECT nid, x + 0.03 AS x, y, z - 0.02 AS z FROM cloud) n GROUP BY q.nid)")
def correspondence(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = hosts.point_cloud(spark, sf_dir).select("nid", "x", "y", "z")
    moved = nodes.select("nid", (F.col("x") + 0.03).alias("x"), "y", (F.col("z") - 0.02).alias("z"))
    return rounded(spatial.correspondence(Mesh(nodes, None), Mesh(moved, None)))


@query("SELECT nid FROM bn WHERE (x - 2.2) * (x - 2.2) + (y - 3.1) * (y - 3.1) + (z - 1.7) * (z - 1.7) < 2.5 * 2.5")
def query_idx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.query_idx(hosts.box_mesh(spark, sf_dir), (2.2, 3.1, 1.7), 2.5)


@query(f"""SELECT q, coalesce(ids, '') AS ids FROM (SELECT q.q, CASE WHEN q.q % 4 = 0 THEN CAST(arg_min(n.nid, {{'d': {_D2}, 'n': n.nid}}) AS VARCHAR) ELSE string_agg(n.nid, ',' ORDER BY {_D2}, n.nid) FILTER ({_D2} <= (0.5 + q.q % 3 * 0.4) * (0.5 + q.q % 3 * 0.4)) END AS ids FROM {_Q} q, bn n GROUP BY q.q)""")
def query_idxlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = _points(spark, sf_dir).withColumn("thr", F.when(F.col("q") % 4 == 0, 0.0).otherwise(0.5 + F.col("q") % 3 * 0.4))
    return spatial.query_idxlist(hosts.box_mesh(spark, sf_dir), queries).select("q", s("ids", "ids"))


@query()
def query_idxlist_uvc(spark: SparkSession, sf_dir: str) -> DataFrame:
    mesh = hosts.box_mesh(spark, sf_dir)
    n = float(hosts.box_size(spark, sf_dir))
    uvc = mesh.nodes.select("nid", (F.col("z") / n).alias("z"), F.sqrt((F.col("x") / n - 0.5) ** 2 + (F.col("y") / n - 0.5) ** 2).alias("rho"), F.atan2(F.col("y") / n - 0.5, F.col("x") / n - 0.5).alias("phi"), F.when(F.col("x") * 2 > n, 1.0).otherwise(-1.0).alias("v"))
    p = _points(spark, sf_dir)
    queries = p.select("q", (F.col("z") / n).alias("z"), (F.col("x") / n * 0.5).alias("rho"), (F.col("y") / n * 6.2 - 3.1).alias("phi"), F.when(F.col("q") % 2 == 0, 1.0).otherwise(-1.0).alias("v"), F.lit(1.2).alias("thr"), F.lit(0.1).alias("eps"))
    return spatial.query_idxlist_uvc(mesh, uvc, queries).select("q", s("ids", "ids"))


def _moved_points(spark: SparkSession, sf_dir: str) -> Mesh:
    """The points, half a box further along x."""
    half = hosts.box_size(spark, sf_dir) * 0.5
    return Mesh(_points(spark, sf_dir, "nid").withColumn("x", F.col("x") + half), None)


@query(f""", m AS (SELECT avg({_SIX}) AS e FROM bp), near AS (SELECT DISTINCT n.nid FROM bn n, (SELECT q, x + (SELECT n FROM base) * 0.5 AS x, y, z FROM {_Q}) q, m WHERE {_D2} <= (e * 1.5) * (e * 1.5)) SELECT DISTINCT eid FROM bi WHERE nid IN (SELECT nid FROM near)""")
def extract_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = _moved_points(spark, sf_dir)
    return spatial.extract_overlap(hosts.box_mesh(spark, sf_dir), other, 1.5)


@query(f"""SELECT eid FROM be WHERE eid NOT IN (SELECT eid FROM bi JOIN (SELECT DISTINCT n.nid FROM bn n, (SELECT q, x + (SELECT n FROM base) * 0.5 AS x, y, z FROM {_Q}) q, (SELECT avg({_SIX}) AS e FROM bp) WHERE {_D2} <= (e * 1.5) * (e * 1.5)) USING (nid))""")
def extract_overlap_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = _moved_points(spark, sf_dir)
    return spatial.extract_overlap(hosts.box_mesh(spark, sf_dir), other, 1.5, complement=True)


# ---- interpolation

@query(f"SELECT q AS idx, {R('x + 2.0 * y - 3.0 * z', 'value')} FROM {_Q} WHERE x BETWEEN 0.2 AND (SELECT n FROM base) - 0.2 AND y BETWEEN 0.2 AND (SELECT n FROM base) - 0.2 AND z BETWEEN 0.2 AND (SELECT n FROM base) - 0.2")
def interpolate_nodedata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear data are interpolated exactly inside the box."""
    mesh = hosts.box_mesh(spark, sf_dir)
    n = hosts.box_size(spark, sf_dir)
    inner = _points(spark, sf_dir, "nid").filter(F.col("x").between(0.2, n - 0.2) & F.col("y").between(0.2, n - 0.2) & F.col("z").between(0.2, n - 0.2))
    return rounded(interpolation.interpolate_nodedata(mesh, inner, hosts.linear_data(mesh)))


@query(f"SELECT eid AS idx, {R('value', 'value')} FROM be JOIN bed ON bed.idx = eid")
def interpolate_elemdata(spark: SparkSession, sf_dir: str) -> DataFrame:
    mesh = hosts.box_mesh(spark, sf_dir)
    return rounded(interpolation.interpolate_elemdata(mesh, mesh, hosts.element_data(mesh)))


@query(f"SELECT q.nid AS idx, {R(f'coalesce(max(CASE WHEN {_D2} = 0 THEN n.value END), sum(n.value / CASE WHEN {_D2} > 0 THEN pow({_D2}, 2.0) END) / sum(1.0 / CASE WHEN {_D2} > 0 THEN pow({_D2}, 2.0) END))', 'value')} FROM (SELECT nid, x + 0.01 AS x, y, z FROM cloud) q, cloud n GROUP BY q.nid")
def interpolate_cloud_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    cloud = hosts.point_cloud(spark, sf_dir)
    points = cloud.select(F.col("nid").alias("idx"), (F.col("x") + 0.01).alias("x"), "y", "z")
    return rounded(interpolation.interpolate_clouddata(points, cloud, 1))


@query(f""", kn AS (SELECT * FROM (SELECT q.nid AS q, n.value, sqrt({_D2}) AS d, row_number() OVER (PARTITION BY q.nid ORDER BY {_D2}, n.nid) AS rank FROM (SELECT nid, x + 0.01 AS x, y, z FROM cloud) q, cloud n) WHERE rank <= 18), rr AS (SELECT q, max(d) AS r FROM kn GROUP BY q),
ww AS (SELECT q, value, pow((r - d) / (r * d), 2) AS w FROM kn JOIN rr USING (q)) SELECT q AS idx, {R('sum(w * value) / sum(w)', 'value')} FROM ww GROUP BY q""")
def interpolate_cloud_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    cloud = hosts.point_cloud(spark, sf_dir)
    points = cloud.select(F.col("nid").alias("idx"), (F.col("x") + 0.01).alias("x"), "y", "z")
    return rounded(interpolation.interpolate_clouddata(points, cloud, 0))


@query()
def interpolate_cloud_rbf(spark: SparkSession, sf_dir: str) -> DataFrame:
    cloud = hosts.point_cloud(spark, sf_dir)
    points = cloud.select(F.col("nid").alias("idx"), (F.col("x") + 0.01).alias("x"), "y", "z")
    return rounded(interpolation.interpolate_clouddata(points, cloud, 2))


# ---- traversal

@query("SELECT nid AS node FROM bn WHERE (x - 0.0) * (x - 0.0) + (y - 0.0) * (y - 0.0) + (z - 0.0) * (z - 0.0) < 9.0")
def reach_in_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reach_in_radius(hosts.box_mesh(spark, sf_dir), 0, 3.0).select("node")


@query("SELECT DISTINCT b.nid AS node FROM (SELECT DISTINCT b.nid FROM bi a JOIN bi b USING (eid) WHERE a.nid = 0) x JOIN bi a USING (nid) JOIN bi b USING (eid)")
def reach_two_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    mesh = hosts.box_mesh(spark, sf_dir)
    return graph.reach(graph.nodal_links(mesh), mesh.nodes.filter("nid = 0").select(F.col("nid").alias("node")), rounds=2).select("node")


@query()
def generate_distancefield(spark: SparkSession, sf_dir: str) -> DataFrame:
    mesh = hosts.box_mesh(spark, sf_dir)
    n = hosts.box_size(spark, sf_dir)
    start, end = mesh.nodes.filter(F.col("nid") % (n + 1) == 0).select("nid"), mesh.nodes.filter(F.col("nid") % (n + 1) == n).select("nid")
    return rounded(graph.distance_field(mesh, start, end))


@query()
def graph_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    mesh = hosts.box_mesh(spark, sf_dir)
    return rounded(graph.graph_distance(mesh, mesh.nodes.filter("nid = 0").select("nid")))


@query("SELECT x.nid, arg_min(n.nbr, {'v': d.value, 'n': n.nbr}) AS minimum FROM bn x JOIN (SELECT DISTINCT a.nid, b.nid AS nbr FROM bi a JOIN bi b USING (eid)) n USING (nid) JOIN (SELECT nid AS idx, x + 2 * y + 3 * z AS value FROM bn) d ON d.idx = n.nbr WHERE x.x < 1 AND x.y < 1 AND x.z < 1 GROUP BY x.nid")
def descend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the cell at the origin the walk ends at the corner in one step."""
    mesh = hosts.box_mesh(spark, sf_dir)
    data = mesh.nodes.select(F.col("nid").alias("idx"), (F.col("x") + 2 * F.col("y") + 3 * F.col("z")).alias("value"))
    return graph.descend(mesh, data).join(mesh.nodes.filter("x < 1 and y < 1 and z < 1"), "nid").select("nid", "minimum")


@query()
def transport(spark: SparkSession, sf_dir: str) -> DataFrame:
    mesh = hosts.box_mesh(spark, sf_dir)
    n = hosts.box_size(spark, sf_dir)
    seeds = mesh.nodes.filter(F.col("nid") % (n + 1) == 0).select("nid", F.col("y").alias("value"))
    direction = mesh.nodes.select(F.col("nid").alias("idx"), F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0)).alias("value"))
    return rounded(graph.transport(mesh, seeds, direction, 0.9))


@query()
def partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.partition(hosts.box_mesh(spark, sf_dir), 3).groupBy("part").agg(F.count("*").alias("n"))


@query()
def reindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reverse_cuthill_mckee(hosts.box_mesh(spark, sf_dir))


# ---- smoothing

@query(f""", nn AS (SELECT DISTINCT a.nid, b.nid AS nbr FROM bi a JOIN bi b USING (eid)), s0 AS (SELECT idx, value FROM bd),
{", ".join(f"s{i + 1} AS (SELECT nid AS idx, any_value(v.value) + {'0.15' if i % 2 == 0 else '(-1.04 * 0.15)'} * (avg(s{i}.value) - any_value(v.value)) AS value FROM nn JOIN s{i} ON s{i}.idx = nbr JOIN s{i} v ON v.idx = nid GROUP BY nid)" for i in range(4))} SELECT idx, {R('value', 'value')} FROM s4""")
def smooth_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    mesh = hosts.box_mesh(spark, sf_dir)
    return rounded(smoothing.smooth_data(mesh, hosts.nodal_data(mesh), 0.15, 2))


@query()
def smooth_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(smoothing.smooth_mesh(hosts.box_mesh(spark, sf_dir), rounds=3, degrees=45.0).nodes)


@query()
def smooth_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(smoothing.smooth_surface(hosts.box_mesh(spark, sf_dir), rounds=3, degrees=45.0).nodes)


@query()
def clean_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.quality_summary(smoothing.clean_quality(hosts.box_mesh(spark, sf_dir), 0.35, layers=1, rounds=3), 0.35))


def _cables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cable along x for each order, of as many points as it has lines; two thirds of them zigzag, some too much to be straight."""
    lines = hosts.read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("long").alias("cid")).agg(F.count("*").alias("n"))
    spot = lambda i: F.struct((i * 10.0).alias("x"), ((i % 2) * (F.col("cid") % 3) * 4.0).alias("y"), F.col("cid").cast("double").alias("z"))
    return lines.select("cid", F.transform(F.sequence(F.lit(0), (F.col("n") - 1).cast("int")), spot).alias("pts"))


_CABLES = """, cb AS (SELECT l_orderkey AS cid, count(*) AS n, (l_orderkey % 3) * 4.0::DOUBLE AS a FROM lineitem GROUP BY 1 HAVING count(*) > 1),
ce AS (SELECT *, (n - 1) * 10.0::DOUBLE AS dx, ((n - 1) % 2) * a AS dy FROM cb), cp AS (SELECT *, unnest(range(n)) AS p FROM ce),
cs AS (SELECT cid, n, a, dx, dy, min(CASE WHEN p > 0 THEN (p * 10 * dx + (p % 2) * a * dy) / (sqrt(p * 10 * p * 10 + (p % 2) * a * a) * sqrt(dx * dx + dy * dy)) END) >= 0.9 AS straight,
  greatest((CAST(trunc(sqrt(dx * dx + dy * dy)) AS BIGINT) + 24) // 25, 1) AS k FROM cp GROUP BY cid, n, a, dx, dy)"""


@query(f"""{_CABLES} SELECT CAST(cid AS BIGINT) AS cid, CAST(p AS BIGINT) AS pos, {R('CASE WHEN straight THEN dx * p / k ELSE p * 10.0 END', 'x')}, {R('CASE WHEN straight THEN dy * p / k ELSE (p % 2) * a END', 'y')}, CAST(cid AS DOUBLE) AS z
FROM (SELECT *, unnest(range(CAST(CASE WHEN straight THEN k + 1 ELSE n END AS BIGINT))) AS p FROM cs)""")
def resample_purkinje(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(smoothing.curve_resampling(_cables(spark, sf_dir), 25.0))


@query("SELECT sum(n) AS n_nodes, sum(n - 1) AS n_lines FROM (SELECT CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1)")
def purkinje_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    spots = _cables(spark, sf_dir).filter(F.size("pts") > 1).select("cid", F.posexplode("pts").alias("pos", "p")).select("cid", "pos", "p.x", "p.y", "p.z")
    mesh = smoothing.cables_to_mesh(spots)
    return mesh.nodes.agg(F.count("*").alias("n_nodes")).crossJoin(mesh.elements.agg(F.count("*").alias("n_lines")))


# ---- time series

@query(f"SELECT CAST(t // 3 AS BIGINT) AS t, idx, {R('value', 'value')} FROM (SELECT t - 2 AS t, idx, value FROM ev WHERE t BETWEEN 2 AND 20) WHERE t % 3 = 0")
def series_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(series.window(hosts.event_series(spark, sf_dir), 2, 20, 3))


@query(f"SELECT CAST(t AS BIGINT) AS t, idx, {R('value', 'value')} FROM ev UNION ALL SELECT u, idx, {R('value', 'value')} FROM ev, (SELECT max(t) AS m FROM ev), range(40) r(u) WHERE t = m AND u > m")
def series_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(series.extend(hosts.event_series(spark, sf_dir), 40))


@query(f"SELECT CAST(u AS BIGINT) AS t, idx, {R('value', 'value')} FROM (SELECT DISTINCT t AS u FROM ev) JOIN ev ON t = least(u, 9)")
def fillup_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(series.hold_from(hosts.event_series(spark, sf_dir), 10))


@query(f"SELECT u AS t, idx, {R('value', 'value')} FROM (SELECT max(t) + 1 AS total FROM ev), LATERAL (SELECT unnest(range(4 + 2 * (total - 4))) AS u), ev WHERE t = CASE WHEN u <= 3 THEN u ELSE 4 + (u - 4) % (total - 4) END")
def series_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(series.periodic(hosts.event_series(spark, sf_dir), 2, 3))


@query(f"SELECT CAST(t AS BIGINT) AS t, idx, {R('v', 'v')}, {R('w', 'w')} FROM (SELECT * FROM (SELECT DISTINCT idx FROM ev), (SELECT unnest(range(max(t) + 1)) AS t FROM ev)) LEFT JOIN (SELECT t, idx, value AS v FROM ev) USING (t, idx) LEFT JOIN (SELECT idx, sum(value) AS w FROM ev GROUP BY idx) USING (idx)")
def collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = hosts.event_series(spark, sf_dir)
    total = data.groupBy("idx").agg(F.sum("value").alias("value"))
    return rounded(series.collect(data.select("idx").distinct(), {"v": data, "w": total}))


@query(f", sp AS (SELECT idx, sum(value) AS value FROM ev GROUP BY idx), tr AS (SELECT t, avg(value) AS w FROM ev GROUP BY t) SELECT CAST(t AS BIGINT) AS t, idx, {R('value / (SELECT max(abs(value)) FROM sp) * w * 2.0', 'value')} FROM sp, tr")
def spatio_temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = hosts.event_series(spark, sf_dir)
    return rounded(series.spatio_temporal(data.groupBy("idx").agg(F.sum("value").alias("value")), data.groupBy("t").agg(F.avg("value").alias("value")), 2.0))


@query(f"SELECT CAST(t AS BIGINT) AS t, idx, {R('CASE WHEN idx % 3 = 0 THEN 0.0 ELSE value END', 'value')} FROM ev")
def deactivate(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = hosts.event_series(spark, sf_dir)
    return rounded(series.deactivate(data, data.filter("idx % 3 = 0").select("idx")))


@query(f"SELECT CAST(t AS BIGINT) AS t, CAST(b.idx AS BIGINT) AS idx, {R('coalesce(CASE WHEN b.idx % 2 = 0 THEN e.value END, CASE WHEN b.idx % 3 = 0 THEN e.value * 10 END, 0.0)', 'value')} FROM (SELECT t, idx FROM (SELECT DISTINCT t FROM ev), (SELECT unnest(range(200)) AS idx)) b LEFT JOIN ev e USING (t, idx)")
def combine_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = hosts.event_series(spark, sf_dir)
    mapping = data.select("idx").distinct().select((F.col("idx") + 1000).alias("sub_idx"), F.col("idx").alias("mesh_idx"))
    part = lambda k, f: data.filter(F.col("idx") % k == 0).select("t", (F.col("idx") + 1000).alias("idx"), (F.col("value") * f).alias("value"))
    # the SQL's base mesh ends at id 199; this one goes on to the last user
    base = data.agg(F.max("idx").alias("last")).select(F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(199).cast("long"), "last"))).alias("idx"))
    return rounded(series.combine(base, [(part(3, 10.0), mapping), (part(2, 1.0), mapping)]))


@query(_NORMAL + f", rw AS (SELECT t, eid, nx, ny, nz, area FROM un, range(3) r(t)) SELECT t, {R('sum(sqrt(((t+1)*nx + 0.5*ny)*((t+1)*nx + 0.5*ny) + (0.5*nx + 2*ny)*(0.5*nx + 2*ny) + (eid % 5 * nz)*(eid % 5 * nz)) * area)', 'value')} FROM rw GROUP BY t")
def reaction_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    mesh = hosts.box_mesh(spark, sf_dir)
    faces = surface.face_normals(mesh, surface.boundary(mesh)).select("eid", "fkey", *(F.col(f"normal.{c}").alias(f"n{c}") for c in "xyz"), "area")
    zero, half = F.lit(0.0), F.lit(0.5)
    stress = mesh.elements.select("eid", F.explode(F.array(*(F.lit(i) for i in range(3)))).alias("t")).select("t", "eid", F.array((F.col("t") + 1).cast("double"), half, zero, half, F.lit(2.0), zero, zero, zero, (F.col("eid") % 5).cast("double")).alias("s"))
    return rounded(series.reaction_force(stress, faces))


@query(f"SELECT CAST(t AS BIGINT) AS t, nid, {R('x * (1 + t * 0.1) * 2.0 - x', 'ux')}, {R('y * 2.0 - y', 'uy')}, {R('(z + t) * 2.0 - z', 'uz')} FROM bn, range(3) r(t)")
def displacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    mesh = hosts.box_mesh(spark, sf_dir)
    moved = mesh.nodes.crossJoin(spark.range(3).select(F.col("id").cast("int").alias("t"))).select("t", "nid", (F.col("x") * (1 + F.col("t") * 0.1)).alias("x"), "y", (F.col("z") + F.col("t")).alias("z"))
    return rounded(series.displacement(moved, mesh.nodes, 2.0))


@query()
def refine_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(series.refine_time(hosts.event_series(spark, sf_dir), 3))


@query(f"SELECT nid, {R('CASE WHEN (x - 1) + (y - 2) > 0 THEN (nid * 37) % 101 / 10.0::DOUBLE + 5.0 ELSE (nid * 37) % 101 / 10.0::DOUBLE END', 'value')} FROM bn")
def same_side_of_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes on the far side of the plane x + y = 3 get five more."""
    mesh = hosts.box_mesh(spark, sf_dir)
    p = tuple(F.col(c) for c in "xyz")
    a, b, c = (tuple(F.lit(float(v)) for v in q) for q in ((1, 2, 0), (0, 3, 0), (1, 2, 1)))
    value = (F.col("nid") * 37) % 101 / F.lit(10.0)
    return rounded(mesh.nodes.select("nid", F.when(G.plane_side(p, a, b, c) > 0, value + 5.0).otherwise(value).alias("value")))


# ---- voxel images

def _voxels(image: voxels.Image) -> DataFrame:
    return rounded(image.voxels.select("i", "j", "k", "value"))


_B = "CAST({} AS BIGINT)"
_IJK = lambda i, j, k: f"{_B.format(i)} AS i, {_B.format(j)} AS j, {_B.format(k)} AS k"


@query(f"SELECT {_IJK('n - 1 - i', 'j', 'n - 1 - k')}, value FROM img")
def itk_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _voxels(voxels.flip(hosts.lattice_image(spark, sf_dir), "xz"))


@query(f"SELECT {_IJK('i + 1', 'j + 2', 'k + 3')}, value FROM img")
def itk_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _voxels(voxels.pad(hosts.lattice_image(spark, sf_dir), (1, 2, 3)))


@query(f", b AS (SELECT min(i) AS a, max(i) AS d, min(j) AS b, max(j) AS e, min(k) AS c, max(k) AS f FROM img WHERE value <> 0) SELECT {_IJK('i - b.a', 'j - b.b', 'k - b.c')}, value FROM img, b WHERE i BETWEEN b.a AND b.d AND j BETWEEN b.b AND b.e AND k BETWEEN b.c AND b.f")
def itk_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _voxels(voxels.crop(hosts.lattice_image(spark, sf_dir)))


@query(f"SELECT {_IJK('i * 2 + u', 'j', 'k * 3 + w')}, value FROM img, range(2) a(u), range(3) c(w)")
def itk_refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _voxels(voxels.refine(hosts.lattice_image(spark, sf_dir), (2, 1, 3)))


@query(f"SELECT {_IJK('i', 'y', 'z')}, value FROM img, LATERAL (SELECT unnest(range(n * 2)) AS y) a, LATERAL (SELECT unnest(range(CAST(floor(n * 1.5) AS BIGINT))) AS z) b WHERE j = floor((y + 0.5) / 2.0) AND k = floor((z + 0.5) / 1.5)")
def itk_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _voxels(voxels.normalize(hosts.lattice_image(spark, sf_dir)))


@query(f"SELECT {_IJK('i', 'CASE j WHEN 1 THEN 0 WHEN 3 THEN 1 ELSE 2 END', 'k')}, value FROM img WHERE j IN (1, 3, 5)")
def itk_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _voxels(voxels.slices(hosts.lattice_image(spark, sf_dir), "xz", [5, 1, 3]))


@query(f"SELECT {_IJK('(i + 2) % n', '(j + n - 1) % n', 'k')}, value FROM img")
def itk_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _voxels(voxels.shift(hosts.lattice_image(spark, sf_dir), (2, -1, 0)))


@query(f"SELECT {_IJK('i', 'j', 'k')}, CAST(CASE WHEN CAST(trunc(value * 100.7) AS BIGINT) % 256 >= 128 THEN CAST(trunc(value * 100.7) AS BIGINT) % 256 - 256 ELSE CAST(trunc(value * 100.7) AS BIGINT) % 256 END AS DOUBLE) AS value FROM img")
def itk_dtype(spark: SparkSession, sf_dir: str) -> DataFrame:
    image = hosts.lattice_image(spark, sf_dir)
    return _voxels(voxels.dtype(voxels.Image(image.voxels.withColumn("value", F.col("value") * 100.7), image.dim), 2))


def _close_sql(source: str, name: str, tag: int, rounds: int) -> str:
    """CTEs that close ``tag`` over the relation ``source`` (i, j, k, value), into ``name``: a box of one voxel, clipped to the image."""
    box = "(SELECT a, b, c FROM (VALUES (-1), (0), (1)) x(a), (VALUES (-1), (0), (1)) y(b), (VALUES (-1), (0), (1)) z(c))"
    out = f", {name}_0 AS (SELECT i, j, k FROM {source} WHERE value = {tag})"
    for n in range(rounds):
        out += f""", {name}_d{n} AS (SELECT DISTINCT g.i, g.j, g.k FROM {name}_{n} s, {box} JOIN img g ON g.i = s.i + a AND g.j = s.j + b AND g.k = s.k + c),
{name}_e{n} AS (SELECT DISTINCT g.i - a AS i, g.j - b AS j, g.k - c AS k FROM (SELECT i, j, k FROM img EXCEPT SELECT * FROM {name}_d{n}) g, {box}), {name}_{n + 1} AS (SELECT * FROM {name}_d{n} EXCEPT SELECT * FROM {name}_e{n})"""
    return out + f", {name} AS (SELECT i, j, k, {tag}.0::DOUBLE AS value FROM {name}_{rounds} UNION ALL SELECT i, j, k, value FROM {source} ANTI JOIN {name}_{rounds} USING (i, j, k) WHERE value <> 0)"


@query(f"{_close_sql('img', 'o', 2, 1)} SELECT {_IJK('i', 'j', 'k')}, value FROM o")
def itk_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The radius is in units of the first axis' spacing: with spacings of 1, 2 and 1.5 it reaches one voxel along each axis."""
    return _voxels(voxels.close(hosts.lattice_image(spark, sf_dir), [2], (1, 2, 2)))


_SPARSE = ", sp AS (SELECT i, j, k, CASE WHEN (i * 3 + j * 5 + k * 7) % 11 < 3 THEN value ELSE 0 END AS value FROM img)"


@query(f"{_SPARSE}{_close_sql('sp', 'o', 1, 2)}{_close_sql('o', 'q', 3, 2)} SELECT {_IJK('i', 'j', 'k')}, value FROM q")
def itk_close_two_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tags, two rounds: dilation and erosion alternate, and the second tag covers what it closes of the first."""
    image = hosts.lattice_image(spark, sf_dir)
    sparse = image.voxels.filter("(i * 3 + j * 5 + k * 7) % 11 < 3")
    return _voxels(voxels.close(voxels.Image(sparse, image.dim), [1, 3], rounds=2))


@query()
def itk_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _voxels(voxels.smooth(hosts.lattice_image(spark, sf_dir), rounds=2))


@query(f"SELECT {_IJK('i', 'j', 'k')}, CASE WHEN {_CUBE.format('(i + 0.5)', '(j + 0.5)', '(k + 0.5)')} THEN 3.0::DOUBLE ELSE 0.0::DOUBLE END AS value FROM img")
def itk_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = hosts.box_size(spark, sf_dir)
    return _voxels(voxels.sample(spark, (0.0, 0.0, 0.0), (1.0, 1.0, 1.0), (n, n, n), _inner_box(spark, sf_dir), 3))


@query(f"SELECT {_IJK('i', 'j', 'k')}, CASE WHEN i = j THEN 9.0::DOUBLE ELSE value END AS value FROM img WHERE (i + j + k) % 2 = 0 OR i = j")
def itk_mask_and_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    image = hosts.lattice_image(spark, sf_dir)
    where = voxels.Image(image.voxels.filter("(i + j + k) % 2 = 0").withColumn("value", F.lit(1.0)), image.dim)
    return _voxels(voxels.set_value(voxels.mask(image, where), image.voxels.filter("i = j"), 9.0))


@query("SELECT count(*) AS n_elements, round(sum(1.0 * 2.0 * 1.5), 4) + 0.0::DOUBLE AS total FROM img WHERE value <> 0")
def voxel_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    mesh = voxels.voxel_mesh(hosts.lattice_image(spark, sf_dir))
    return stats.volumes(mesh).agg(F.count("*").alias("n_elements"), (F.round(F.sum("value"), 4) + F.lit(0.0)).alias("total"))
