"""Mesh statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trellis.functions import geometry as G
from trellis.model import EDGES, Mesh, by_type


def query_tags(mesh: Mesh) -> DataFrame:
    """(tag, kind): distinct tags; a tag with any fibred element is myocardium, all others bath. The fibre test is the
    looser one: a fibre counts unless all its components are below 1e-6 (negative ones count as below)."""
    f = F.col("fib")
    bath = F.coalesce((f[0] < 1e-6) & (f[1] < 1e-6) & (f[2] < 1e-6), F.lit(False))
    kinds = mesh.elements.groupBy("tag").agg(F.max((~bath).cast("int")).alias("m"))
    return kinds.select("tag", F.when(F.col("m") == 1, "myocard").otherwise("bath").alias("kind"))


def counts(mesh: Mesh) -> DataFrame:
    return mesh.elements.agg(F.count("*").alias("n_elements")).crossJoin(mesh.nodes.agg(F.count("*").alias("n_nodes")))


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """(bin, low, n, fraction): bins of equal width and a last one that holds the maximum alone; constant data fill bin 0."""
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("total"))
    width = (F.col("hi") - F.col("lo")) / bins
    placed = df.crossJoin(F.broadcast(ends)).select(F.when(F.col("hi") > F.col("lo"), F.floor((F.col(value) - F.col("lo")) / width)).otherwise(F.lit(0)).cast("int").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    every = ends.select("lo", "hi", "total", F.explode(F.sequence(F.lit(0), F.lit(bins))).alias("bin"))
    joined = every.join(placed, "bin", "left")
    return joined.select("bin", (F.col("lo") + F.col("bin") * width).alias("low"), F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) / F.col("total")).alias("fraction"))


def summary(df: DataFrame, value: str, *more: Column) -> DataFrame:
    """One row: n, total, mean, sample deviation, least, greatest, and further aggregates of the same pass."""
    v = F.col(value)
    return df.agg(F.count(v).alias("n"), F.sum(v).alias("total"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.min(v).alias("lo"), F.max(v).alias("hi"), *more)


def connections(mesh: Mesh) -> DataFrame:
    """(nid, value): neighbours of each node, itself included."""
    return mesh.n2n.groupBy("nid").agg(F.count("*").cast("double").alias("value"))


def edge_lengths(mesh: Mesh, pairs: DataFrame | None = None) -> DataFrame:
    """(v1, v2, len2) of distinct edges; by default the true edges of lines, triangles and tetrahedra."""
    pairs = mesh.element_edges.select("v1", "v2").distinct() if pairs is None else pairs
    a, b = (mesh.nodes.select(F.col("nid").alias(v), F.struct("x", "y", "z").alias(f"p{v}")) for v in ("v1", "v2"))
    return pairs.join(a, "v1").join(b, "v2").select("v1", "v2", G.dist2(G.vec(F.col("pv2")), G.vec(F.col("pv1"))).alias("len2"))


def lengths(mesh: Mesh) -> DataFrame:
    """(v1, v2, value): lengths of all node pairs that share an element."""
    return edge_lengths(mesh, mesh.pairs).select("v1", "v2", F.sqrt("len2").alias("value"))


def volumes(mesh: Mesh) -> DataFrame:
    """(eid, value)."""
    return mesh.points.select("eid", G.volume(F.col("etype"), F.col("pts")).alias("value"))


def quality(mesh: Mesh, metric: str = "volume") -> DataFrame:
    """(eid, value) of tetrahedra and triangles; 0 is best."""
    tet = {"volume": G.tet_quality, "shape": G.shape_distance, "angle": G.dihedral_minimum}[metric]
    p = F.col("pts")
    value = F.when(F.col("etype") == "Tt", tet(p)).when(F.col("etype") == "Tr", G.tri_quality(p))
    return mesh.points.select("eid", value.alias("value")).filter("value is not null")


def quality_summary(mesh: Mesh, threshold: float) -> DataFrame:
    """Summary of the quality and the number strictly above ``threshold``."""
    return summary(quality(mesh), "value", F.count_if(F.col("value") > threshold).alias("n_above"))


def quality_histogram(mesh: Mesh, bins: int = 50) -> DataFrame:
    """(bin, fraction) over [0, 1]."""
    counts = quality(mesh).groupBy(F.least(F.floor(F.col("value") * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # over at most ``bins`` rows
    return counts.select("bin", (F.col("n") / total).alias("fraction"))


def nodal_quality(mesh: Mesh) -> DataFrame:
    """(nid, mean, worst) of the adjacent elements' quality."""
    return mesh.e2n.join(quality(mesh), "eid").groupBy("nid").agg(F.avg("value").alias("mean"), F.max("value").alias("worst"))


def bandwidth(mesh: Mesh) -> DataFrame:
    """(nid, value): spread of the neighbours' ids."""
    return mesh.n2n.groupBy("nid").agg((F.max("nbr") - F.min("nbr")).cast("double").alias("value"))


def pattern(mesh: Mesh, rows: int = 30, columns: int = 60) -> DataFrame:
    """(row, col, n): the matrix of neighbours in a coarse grid."""
    top = mesh.nodes.agg((F.max("nid") + 1).alias("top"))
    cell = lambda c, k: F.floor(F.col(c) * k / F.col("top")).cast("int")
    spot = lambda a, b: F.struct(cell(a, rows).alias("row"), cell(b, columns).alias("col"))
    half = mesh.n2n.filter("nid <= nbr").crossJoin(F.broadcast(top))  # the other half is its mirror
    return half.select(F.explode(F.when(F.col("nid") == F.col("nbr"), F.array(spot("nid", "nbr"))).otherwise(F.array(spot("nid", "nbr"), spot("nbr", "nid")))).alias("s")).groupBy("s.row", "s.col").agg(F.count("*").alias("n"))


def own_lengths(etype: Column, pts: Column) -> Column:
    """Array of the lengths of an element's edges."""
    edges = by_type(EDGES, F.sequence(F.lit(0), F.size(pts) - 1).cast("array<long>"), etype)
    return F.transform(edges, lambda e: F.sqrt(G.dist2(G.vec(F.element_at(pts, (e[0] + 1).cast("int"))), G.vec(F.element_at(pts, (e[1] + 1).cast("int"))))))


def longest_edge(etype: Column, pts: Column) -> Column:
    return F.array_max(own_lengths(etype, pts))


def element_edge_means(mesh: Mesh) -> DataFrame:
    """(eid, mean, least): edge lengths of each element."""
    rows = mesh.points.select("eid", own_lengths(F.col("etype"), F.col("pts")).alias("l"))
    return rows.select("eid", (F.aggregate("l", F.lit(0.0), lambda a, b: a + b) / F.size("l")).alias("mean"), F.array_min("l").alias("least"))


def average_edge_length(mesh: Mesh) -> DataFrame:
    """One row: mean over the elements of their mean edge length, and the least edge. Always full, never sampled."""
    return element_edge_means(mesh).agg(F.avg("mean").alias("mean"), F.min("least").alias("least"))


def nodal_sizing(mesh: Mesh) -> DataFrame:
    """(nid, value): mean distance to the neighbours, itself left out."""
    both = lengths(mesh)
    return both.select(F.col("v1").alias("nid"), "value").unionByName(both.select(F.col("v2").alias("nid"), "value")).groupBy("nid").agg(F.avg("value").alias("value"))


def meeting(mesh: Mesh, most: int = 100) -> DataFrame:
    """Edges (v1, v2, pv1, pv2) with the triangles (eid, con, pts) that they share a cell with.

    The cells of the grid are twice as wide as a mean triangle, ``most`` along an axis at most; edges and triangles take those that their boxes cover."""
    from trellis.operators.spatial import AXES, covering, extent
    from trellis.session import cut

    lo, hi, _ = extent(mesh.nodes)
    a, b = (mesh.nodes.select(F.col("nid").alias(v), F.struct("x", "y", "z").alias(f"p{v}")) for v in ("v1", "v2"))
    edges = mesh.element_edges.select("v1", "v2").distinct().join(a, "v1").join(b, "v2")
    faces = cut(mesh.points.filter("etype = 'Tr'").select("eid", "con", "pts"))
    spots = {c: F.transform("pts", G.part(c)) for c in AXES}
    ends = {c: (F.array_min(s), F.array_max(s)) for c, s in spots.items()}
    mean = faces.agg(F.avg(F.greatest(*(top - bottom for bottom, top in ends.values())))).first()[0] or 0.0
    size = max(2.0 * mean, *((h - w) / most for w, h in zip(lo, hi))) or 1.0
    edges = covering(edges, lo, size, {c: (F.least(f"pv1.{c}", f"pv2.{c}"), F.greatest(f"pv1.{c}", f"pv2.{c}")) for c in AXES})
    faces = covering(faces, lo, size, ends)
    return edges.join(faces, ["cx", "cy", "cz"])


def self_intersections(mesh: Mesh) -> DataFrame:
    """(v1, v2, eid): edges that pass through a triangle they share no node with, at a place between 0.01 and 0.99 of the edge.

    Only pairs in a common cell with overlapping boxes are tested."""
    low = lambda c: (F.least(f"pv1.{c}", f"pv2.{c}") <= F.array_max(F.transform("pts", lambda p: p[c]))) & (F.greatest(f"pv1.{c}", f"pv2.{c}") >= F.array_min(F.transform("pts", lambda p: p[c])))
    apart = ~F.array_contains("con", F.col("v1")) & ~F.array_contains("con", F.col("v2"))
    hit = ray_hit(G.vec(F.col("pv1")), G.sub(G.vec(F.col("pv2")), G.vec(F.col("pv1"))), F.col("pts"))
    return meeting(mesh).filter(apart & low("x") & low("y") & low("z")).withColumn("t", hit).filter("t > 0.01 and t < 0.99").select("v1", "v2", "eid").distinct()


def ray_hit(origin: G.Vec, direction: G.Vec, pts: Column) -> Column:
    """Parameter at which a line meets a triangle; null if it doesn't, or lies in its plane but for rounding."""
    a, b, c = (G.at(pts, i) for i in range(3))
    start = F.struct(*(G.point(v).alias(n) for n, v in (("o", origin), ("d", direction), ("a", a), ("u", G.sub(b, a)), ("v", G.sub(c, a)))))

    def products(r: Column) -> Column:
        d, u, v = (G.vec(r[n]) for n in "duv")
        h, s = G.cross(d, v), G.sub(G.vec(r["o"]), G.vec(r["a"]))
        q = G.cross(s, u)
        size = F.sqrt(G.dot(d, d) * G.dot(u, u) * G.dot(v, v))
        return F.struct(G.dot(u, h).alias("det"), size.alias("size"), G.dot(s, h).alias("sh"), G.dot(d, q).alias("dq"), G.dot(v, q).alias("vq"))

    def solve(r: Column) -> Column:
        alpha, beta, t = (G.ratio(r[n], r["det"]) for n in ("sh", "dq", "vq"))
        return F.when((F.abs(r["det"]) > 1e-12 * r["size"]) & (alpha >= 0) & (beta >= 0) & (alpha + beta <= 1), t)

    return G.let(G.let(start, products), solve)


def shared_elements(mesh: Mesh, least: int = 1) -> DataFrame:
    """(nid, nbr, n): node pairs, each node with itself included, that share ``least`` elements or more, and how many they share."""
    pairs = mesh.elements.select("con", F.explode("con").alias("nid")).select("nid", F.explode("con").alias("nbr"))
    return pairs.groupBy("nid", "nbr").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def distance_to_centroid(mesh: Mesh) -> DataFrame:
    """(nid, value): distance of each node to the mean of its neighbours, itself left out."""
    other = mesh.nodes.select(F.col("nid").alias("nbr"), *(F.col(c).alias(f"_{c}") for c in "xyz"))
    means = mesh.n2n.filter("nid <> nbr").join(other, "nbr").groupBy("nid").agg(*(F.avg(f"_{c}").alias(f"_{c}") for c in "xyz"))
    return mesh.nodes.join(means, "nid").select("nid", F.sqrt(sum(((F.col(f"_{c}") - F.col(c)) ** 2 for c in "yz"), (F.col("_x") - F.col("x")) ** 2)).alias("value"))


def bounding_sphere(nodes: DataFrame) -> DataFrame:
    """One row: the mean of the nodes (x, y, z) and the greatest distance from it."""
    centre = nodes.agg(*(F.avg(c).alias(f"_{c}") for c in "xyz"))  # one row
    far = F.max(sum(((F.col(c) - F.col(f"_{c}")) ** 2 for c in "yz"), (F.col("x") - F.col("_x")) ** 2))
    return nodes.crossJoin(F.broadcast(centre)).agg(*(F.first(f"_{c}").alias(c) for c in "xyz"), F.sqrt(far).alias("radius"))


def in_interval(ids: DataFrame, column: str, start: int, stop: int) -> DataFrame:
    """One row (inside): whether all ids are in [start, stop); true for none."""
    return ids.agg(F.coalesce(F.min(F.col(column).between(start, stop - 1)), F.lit(True)).alias("inside"))
