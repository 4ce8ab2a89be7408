"""Meshes over the driver's tables, in Spark and, as common table expressions, in SQL.

``order_mesh``: nodes are parts, elements orders of at least four parts. ``supplier_mesh``: the same with suppliers as nodes, so that
faces are shared. ``box_mesh``: a deformed box of tetrahedra whose size follows the number of parts: a proper manifold.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.model import Mesh

PERMUTATIONS = [(0, 0, 1, 2, 0), (1, 0, 2, 1, 1), (2, 1, 0, 2, 1), (3, 1, 2, 0, 0), (4, 2, 0, 1, 0), (5, 2, 1, 0, 1)]
TASK = 32_768  # cells or nodes of a box that a task makes at most


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fibres(tag: str, bath: int):
    return F.when(F.col(tag) == bath, F.array(*(F.lit(0.0),) * 3)).otherwise(F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0)))


def order_elements(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.substring("o_orderpriority", 1, 1).cast("long").alias("tag"))
    sets = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.col(column).cast("long"))).alias("con")).filter(F.size("con") >= 4)
    rows = sets.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(F.col("o_orderkey").cast("long").alias("eid"), F.lit("Tt").alias("etype"), F.slice("con", 1, 4).alias("con"), "tag", fibres("tag", 5).alias("fib"))


def order_mesh(spark: SparkSession, sf_dir: str) -> Mesh:
    nodes = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("nid"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").cast("double").alias("y"), F.regexp_extract("p_brand", "[0-9]+", 0).cast("double").alias("z"))
    return Mesh(nodes, order_elements(spark, sf_dir, "l_partkey"))


def supplier_mesh(spark: SparkSession, sf_dir: str) -> Mesh:
    nodes = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("nid"), (F.col("s_acctbal").cast("double") / 1000.0).alias("x"), F.col("s_nationkey").cast("double").alias("y"), (F.col("s_suppkey") % 10).cast("double").alias("z"))
    return Mesh(nodes, order_elements(spark, sf_dir, "l_suppkey"))


def box_size(spark: SparkSession, sf_dir: str) -> int:
    return int(read(spark, sf_dir, "part").count() ** (1 / 3) + 1e-9)


def numbers(spark: SparkSession, n: int) -> DataFrame:
    """(id) below n, in tasks of bounded size."""
    return spark.range(0, n, 1, max(spark.sparkContext.defaultParallelism, math.ceil(n / TASK)))


def box_nodes(spark: SparkSession, n: int) -> DataFrame:
    m = n + 1
    i, j, k = F.col("id") % m, F.floor(F.col("id") / m) % m, F.floor(F.col("id") / (m * m))
    return numbers(spark, m**3).select(
        F.col("id").alias("nid"), (i + 0.1 * (((j * 7 + k * 3) % 5) / F.lit(5.0))).alias("x"), (j + 0.1 * (((i * 3 + k * 5) % 7) / F.lit(7.0))).alias("y"), (k + 0.1 * (((i * 5 + j * 2) % 3) / F.lit(3.0))).alias("z"),
    )


def box_mesh(spark: SparkSession, sf_dir: str, keep=None) -> Mesh:
    """``keep``: a condition on the cell (i, j, k), for boxes with gaps."""
    n = box_size(spark, sf_dir)
    m = n + 1
    step = (1, m, m * m)
    cells = numbers(spark, n**3).select(F.col("id").alias("cell"), (F.col("id") % n).alias("i"), (F.floor(F.col("id") / n) % n).alias("j"), F.floor(F.col("id") / (n * n)).alias("k"))
    if keep is not None:
        cells = cells.filter(keep)
    o = F.col("i") + F.col("j") * m + F.col("k") * m * m
    tets = []
    for p, a, b, _, odd in PERMUTATIONS:
        inner = [o + step[a], o + step[a] + step[b]]
        tets.append(F.struct(F.lit(p).alias("p"), F.array(o, *(inner[::-1] if odd else inner), o + sum(step)).alias("con")))
    tag = F.lit(1) + (F.col("i") * 2 >= n).cast("int") + 2 * (F.col("k") * 2 >= n).cast("int")
    rows = cells.select("cell", tag.cast("long").alias("tag"), F.explode(F.array(*tets)).alias("t"))
    elements = rows.select((F.col("cell") * 6 + F.col("t.p")).alias("eid"), F.lit("Tt").alias("etype"), F.col("t.con").alias("con"), "tag", fibres("tag", 4).alias("fib"))
    return Mesh(box_nodes(spark, n), elements)


def nodal_data(mesh: Mesh) -> DataFrame:
    return mesh.nodes.select(F.col("nid").alias("idx"), ((F.col("nid") * 37) % 101 / F.lit(10.0)).alias("value"))


def linear_data(mesh: Mesh) -> DataFrame:
    return mesh.nodes.select(F.col("nid").alias("idx"), (F.col("x") + 2.0 * F.col("y") - 3.0 * F.col("z")).alias("value"))


def element_data(mesh: Mesh) -> DataFrame:
    return mesh.elements.select(F.col("eid").alias("idx"), ((F.col("eid") * 31) % 97 / F.lit(10.0)).alias("value"))


def event_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, idx, value): days since the first, users, sum of the day's values."""
    events = read(spark, sf_dir, "events").select(F.to_date("ts").alias("d"), F.col("user_id").cast("long").alias("idx"), "value")
    first = events.agg(F.min("d").alias("first"))
    return events.crossJoin(F.broadcast(first)).groupBy(F.datediff("d", "first").cast("int").alias("t"), "idx").agg(F.sum("value").alias("value"))


def point_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(nid, x, y, z, value): the first three components of the embeddings and the fourth as data."""
    e = lambda i: F.get("embedding", F.lit(i)).cast("double")
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("nid"), e(0).alias("x"), e(1).alias("y"), e(2).alias("z"), e(3).alias("value"))


def lattice_image(spark: SparkSession, sf_dir: str):
    """An image over the box's cells: value 0 to 3 by a rule, with more zeros towards the border."""
    from trellis.operators.voxels import Image

    n = box_size(spark, sf_dir)
    i, j, k = (F.col(c) for c in "ijk")
    cells = spark.range(n**3).select((F.col("id") % n).cast("int").alias("i"), (F.floor(F.col("id") / n) % n).cast("int").alias("j"), F.floor(F.col("id") / (n * n)).cast("int").alias("k"))
    value = F.when((i < 1) | (j < 1) | (k < 1) | (i >= n - 1), 0).otherwise((i * 7 + j * 5 + k * 3) % 4)
    return Image(cells.withColumn("value", value.cast("double")), (n, n, n), (0.0, 0.0, 0.0), (1.0, 2.0, 1.5))


_ELEMENTS = """{name} AS (SELECT CAST(o_orderkey AS BIGINT) AS eid, list_slice(list_sort(list(DISTINCT CAST({column} AS BIGINT))), 1, 4) AS con, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS tag
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderpriority HAVING count(DISTINCT {column}) >= 4)"""
_PERMUTATIONS = ", ".join(str(p) for p in PERMUTATIONS)

# on: order nodes, oe: elements, oi: (eid, pos, nid); sn, se, si: suppliers; bn, be, bi: box; bf: box faces; bp: element with four points
CTE = f"""WITH
{_ELEMENTS.format(name="oe", column="l_partkey")},
onodes AS (SELECT CAST(p_partkey AS BIGINT) AS nid, CAST(p_size AS DOUBLE) AS x, CAST(p_retailprice AS DOUBLE) AS y, CAST(regexp_extract(p_brand, '[0-9]+') AS DOUBLE) AS z FROM part),
oi AS (SELECT eid, tag, unnest(con) AS nid, generate_subscripts(con, 1) - 1 AS pos FROM oe),
{_ELEMENTS.format(name="se", column="l_suppkey")},
snodes AS (SELECT CAST(s_suppkey AS BIGINT) AS nid, CAST(s_acctbal AS DOUBLE) / 1000.0 AS x, CAST(s_nationkey AS DOUBLE) AS y, CAST(s_suppkey % 10 AS DOUBLE) AS z FROM supplier),
si AS (SELECT eid, tag, unnest(con) AS nid, generate_subscripts(con, 1) - 1 AS pos FROM se),
local_faces AS (SELECT * FROM (VALUES (0, 2, 3, 1), (1, 1, 4, 2), (2, 2, 4, 3), (3, 1, 3, 4)) t(fpos, a, b, c)),
sf AS (SELECT eid, tag, fpos, list_sort([con[a], con[b], con[c]]) AS fkey FROM se, local_faces),
base AS (SELECT CAST(floor(power(count(*), 1.0 / 3.0) + 1e-9) AS BIGINT) AS n FROM part),
ax AS (SELECT unnest(range(n + 1)) AS v, n FROM base),
ac AS (SELECT unnest(range(n)) AS v, n FROM base),
bn AS (SELECT a.v + b.v * (a.n + 1) + c.v * (a.n + 1) * (a.n + 1) AS nid, a.v + 0.1::DOUBLE * (((b.v * 7 + c.v * 3) % 5) / 5.0::DOUBLE) AS x, b.v + 0.1::DOUBLE * (((a.v * 3 + c.v * 5) % 7) / 7.0::DOUBLE) AS y,
  c.v + 0.1::DOUBLE * (((a.v * 5 + b.v * 2) % 3) / 3.0::DOUBLE) AS z FROM ax a, ax b, ax c),
perm AS (SELECT * FROM (VALUES {_PERMUTATIONS}) t(p, a, b, c, odd)),
cell AS (SELECT a.n AS n, a.v AS i, b.v AS j, c.v AS k, a.v + b.v * a.n + c.v * a.n * a.n AS cell, a.v + b.v * (a.n + 1) + c.v * (a.n + 1) * (a.n + 1) AS o, [1, a.n + 1, (a.n + 1) * (a.n + 1)] AS s FROM ac a, ac b, ac c),
be AS (SELECT cell * 6 + p AS eid, i, j, k, 1 + CAST(i * 2 >= n AS BIGINT) + 2 * CAST(k * 2 >= n AS BIGINT) AS tag,
  CASE WHEN odd = 1 THEN [o, o + s[a + 1] + s[b + 1], o + s[a + 1], o + s[1] + s[2] + s[3]] ELSE [o, o + s[a + 1], o + s[a + 1] + s[b + 1], o + s[1] + s[2] + s[3]] END AS con FROM cell, perm),
bi AS (SELECT eid, tag, unnest(con) AS nid, generate_subscripts(con, 1) - 1 AS pos FROM be),
bf AS (SELECT eid, tag, fpos, [con[a], con[b], con[c]] AS face, list_sort([con[a], con[b], con[c]]) AS fkey FROM be, local_faces),
bs AS (SELECT fkey, max_by(eid, eid * 4 + fpos) AS eid, max_by(tag, eid * 4 + fpos) AS tag, max_by(face, eid * 4 + fpos) AS face FROM bf GROUP BY fkey HAVING count(*) % 2 = 1),
bp AS (SELECT e.eid, e.tag, e.con, a.x AS x0, a.y AS y0, a.z AS z0, b.x AS x1, b.y AS y1, b.z AS z1, c.x AS x2, c.y AS y2, c.z AS z2, d.x AS x3, d.y AS y3, d.z AS z3
  FROM be e JOIN bn a ON a.nid = e.con[1] JOIN bn b ON b.nid = e.con[2] JOIN bn c ON c.nid = e.con[3] JOIN bn d ON d.nid = e.con[4]),
bv AS (SELECT *, ((y1 - y0) * (z2 - z0) - (z1 - z0) * (y2 - y0)) * (x3 - x0) + ((z1 - z0) * (x2 - x0) - (x1 - x0) * (z2 - z0)) * (y3 - y0) + ((x1 - x0) * (y2 - y0) - (y1 - y0) * (x2 - x0)) * (z3 - z0) AS v6 FROM bp),
bpair AS (SELECT DISTINCT a.nid AS v1, b.nid AS v2 FROM bi a JOIN bi b ON a.eid = b.eid AND a.nid < b.nid),
blen AS (SELECT v1, v2, (q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y) + (q.z - p.z) * (q.z - p.z) AS len2 FROM bpair JOIN bn p ON p.nid = v1 JOIN bn q ON q.nid = v2),
bd AS (SELECT nid AS idx, (nid * 37) % 101 / 10.0::DOUBLE AS value FROM bn),
bed AS (SELECT eid AS idx, (eid * 31) % 97 / 10.0::DOUBLE AS value FROM be),
ev AS (SELECT CAST(date_diff('day', (SELECT min(CAST(ts AS DATE)) FROM events), CAST(ts AS DATE)) AS INTEGER) AS t, CAST(user_id AS BIGINT) AS idx, sum(value) AS value FROM events GROUP BY ALL),
cloud AS (SELECT CAST(vec_id AS BIGINT) AS nid, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, embedding[4]::DOUBLE AS value FROM embeddings),
img AS (SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CAST(k AS INTEGER) AS k, n, CAST(CASE WHEN i < 1 OR j < 1 OR k < 1 OR i >= n - 1 THEN 0 ELSE (i * 7 + j * 5 + k * 3) % 4 END AS DOUBLE) AS value FROM cell)
"""
