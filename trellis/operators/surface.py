"""Boundary surfaces: extraction by face parity, set algebra, restriction, Neumann data.

A surface is a DataFrame (eid, tag, face, fkey): the oriented face, its sorted key, and the element it comes from.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trellis.functions import geometry as G
from trellis.model import FACES, Mesh, by_type, with_points
from trellis.operators import graph
from trellis.operators.select import Submesh, renumber
from trellis.session import cut

COLUMNS = ("eid", "tag", "face", "fkey")


def boundary(mesh: Mesh, tags: list[int] | None = None) -> DataFrame:
    """Faces that occur an odd number of times among the elements (with one of ``tags``); of those the one of greatest eid.
    Elements that are themselves triangles or quadrilaterals are their own faces."""
    elements = mesh.elements if tags is None else mesh.elements.filter(F.col("tag").isin(list(tags)))
    faces = elements.select("eid", "tag", F.posexplode(by_type(FACES, F.col("con"), F.col("etype"))).alias("fpos", "face"))
    faces = faces.withColumn("fkey", F.array_sort("face")).select("eid", "tag", "fpos", "fkey", F.aggregate("face", F.lit(0).cast("long"), lambda s, v: s * 4 + F.array_position("fkey", v) - 1).alias("turn"))
    # only numbers of fixed size are kept for a key, so that it is summed up by hash, not by sorting whole faces; the face is its key in the order of ``turn``
    place = F.col("eid") * 8 + F.col("fpos")
    kept = faces.groupBy("fkey").agg(F.count("*").alias("n"), F.max(place).alias("last"), F.max_by("tag", place).alias("tag"), F.max_by("turn", place).alias("turn")).filter("n % 2 = 1")
    k = F.size("fkey")
    face = F.transform("fkey", lambda _, i: F.element_at("fkey", (F.floor(F.col("turn") / F.pow(F.lit(4), k - 1 - i)) % 4 + 1).cast("int")))
    return kept.select(F.shiftright("last", 3).alias("eid"), "tag", face.alias("face"), "fkey")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("fkey"), "fkey", "left_anti").select(*COLUMNS)


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """Faces of ``a``, with their orientation and owner, that ``b`` has too."""
    return a.join(b.select("fkey"), "fkey", "left_semi").select(*COLUMNS)


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """The left wins on equal keys."""
    return a.select(*COLUMNS).unionByName(difference(b, a))


OPERATORS = ((":", intersection), ("-", difference), ("+", union))


def split_names(text: str, separator: str) -> list[str]:
    """Cut at ``separator`` outside double quotes; the quotes go."""
    parts = re.findall(rf'(?:"[^"]*"|[^"{re.escape(separator)}])+', text)
    return [p.replace('"', "").strip() for p in parts]


def parse_operations(text: str) -> list[tuple[str, list[str], list[str]]]:
    """(operator, left operands, right operands) of each ``;``-separated operation; one operator each, tried as : - +."""
    out = []
    for operation in re.findall(r'(?:"[^"]*"|[^";])+', text):
        for sign, _ in OPERATORS:
            sides = re.findall(rf'(?:"[^"]*"|[^"{re.escape(sign)}])+', operation)
            if len(sides) > 2:
                raise ValueError(f"more than one {sign} in {operation}")
            if len(sides) == 2:
                out.append((sign, split_names(sides[0], ","), split_names(sides[1], ",")))
                break
        else:
            out.append(("", split_names(operation, ","), []))
    return out


def operand(mesh: Mesh, items: list[str], named: dict[str, DataFrame]) -> DataFrame:
    """The surface of all integer tags of the list, joined with the named surfaces."""
    tags = [int(x) for x in items if re.fullmatch(r"-?\d+", x)]
    parts = ([boundary(mesh, tags)] if tags else []) + [named[x] for x in items if not re.fullmatch(r"-?\d+", x)]
    out = parts[0]
    for part in parts[1:]:
        out = union(out, part)
    return out


def extract_surfaces(mesh: Mesh, operations: str | None = None, named: dict[str, DataFrame] | None = None) -> list[DataFrame]:
    """One surface for each operation; without operations the boundary of all elements."""
    if not operations:
        return [boundary(mesh)]
    out = []
    for sign, left, right in parse_operations(operations):
        surface = operand(mesh, left, named or {})
        out.append(dict(OPERATORS)[sign](surface, operand(mesh, right, named or {})) if sign else surface)
    return out


def triangles(surface: DataFrame) -> DataFrame:
    """Quadrilaterals (a, b, c, d) become (a, b, c) and (a, c, d)."""
    f = F.col("face")
    g = lambda i: F.get(f, F.lit(i))
    parts = F.when(F.size(f) == 4, F.array(F.array(g(0), g(1), g(2)), F.array(g(0), g(2), g(3)))).otherwise(F.array(f))
    return surface.withColumn("face", F.explode(parts)).withColumn("fkey", F.array_sort("face")).select(*COLUMNS)


def vertices(surface: DataFrame) -> DataFrame:
    return surface.select(F.explode("face").alias("nid")).distinct()


def neumann(mesh: Mesh, surface: DataFrame) -> DataFrame:
    """(eid, tag, face, sp_vtx): the first node of the face's element that is not on the face, -1 if none."""
    joined = surface.join(mesh.elements.select("eid", "con"), "eid")
    return joined.select("eid", "tag", "face", F.coalesce(F.get(F.array_except("con", "face"), F.lit(0)), F.lit(-1)).cast("long").alias("sp_vtx"))


def surface_mesh(mesh: Mesh, surface: DataFrame, hybrid: bool = False) -> Submesh:
    """The surface as a mesh of its own, faces turned to point outwards; tags and fibres from the owner element."""
    faces = (surface if hybrid else triangles(surface)).select("eid", F.reverse("face").alias("con"))
    typed = faces.join(mesh.elements.select("eid", "tag", "fib"), "eid").withColumn("etype", F.when(F.size("con") == 3, "Tr").otherwise("Qd"))
    place = F.row_number().over(Window.partitionBy("eid").orderBy("con"))  # a hexahedron has at most twelve triangles
    keyed = typed.withColumn("eid", F.col("eid") * 16 + place)
    return renumber(Mesh(mesh.nodes, keyed.select("eid", "etype", "con", "tag", "fib")))


def recover_owner(mesh: Mesh, faces: DataFrame) -> DataFrame:
    """A surface from bare faces (face): the owner is the element of greatest eid with that face."""
    owners = mesh.faces.groupBy("fkey").agg(F.max("eid").alias("eid"))
    keyed = faces.withColumn("fkey", F.array_sort("face")).select("face", "fkey")
    return keyed.join(owners, "fkey").join(mesh.elements.select("eid", "tag"), "eid").select(*COLUMNS)


def from_vertices(mesh: Mesh, nodes: DataFrame) -> DataFrame:
    """Boundary faces whose nodes are all listed in ``nodes`` (nid)."""
    rows = boundary(mesh)
    hits = rows.select("fkey", F.explode("face").alias("nid")).join(nodes.select("nid").distinct(), "nid", "left_semi").groupBy("fkey").agg(F.count("*").alias("n"))
    return rows.join(hits, "fkey").filter(F.col("n") == F.size("face")).select(*COLUMNS)


def drop_faces_with(surface: DataFrame, nodes: DataFrame) -> DataFrame:
    """Faces with none of the listed nodes."""
    hit = surface.select("fkey", F.explode("face").alias("nid")).join(nodes.select("nid").distinct(), "nid", "left_semi").select("fkey").distinct()
    return surface.join(hit, "fkey", "left_anti").select(*COLUMNS)


def face_edges(surface: DataFrame) -> DataFrame:
    """(v1, v2, eid, fkey) of the ring of each face."""
    f = F.col("face")
    ring = F.transform(F.sequence(F.lit(0), F.size(f) - 1), lambda i: F.struct(F.get(f, i).alias("a"), F.get(f, (i + 1) % F.size(f)).alias("b")))
    rows = surface.select("eid", "fkey", F.explode(ring).alias("e"))
    return rows.select(F.least("e.a", "e.b").alias("v1"), F.greatest("e.a", "e.b").alias("v2"), "eid", "fkey")


def border_nodes(surface: DataFrame) -> DataFrame:
    """Nodes of edges with one face only."""
    return face_edges(surface).groupBy("v1", "v2").agg(F.count("*").alias("n")).filter("n = 1").select(F.explode(F.array("v1", "v2")).alias("nid")).distinct()


def face_normals(mesh: Mesh, surface: DataFrame) -> DataFrame:
    """The surface with the outward unit normal and area of each face, from its first three nodes."""
    rows = with_points(surface.withColumn("fid", F.xxhash64("fkey")).withColumn("tri", F.slice("face", 1, 3)), "tri", "fid", mesh.nodes)
    p = [G.at(F.col("pts"), i) for i in range(3)]
    return rows.withColumn("normal", G.point(G.triangle_normal(*p))).withColumn("area", G.triangle_area(*p)).drop("fid", "tri")


def nodal_normals(mesh: Mesh, surface: DataFrame) -> DataFrame:
    """(nid, x, y, z): unit mean of the adjacent faces' normals, weighted by the angle at the node; zero if they cancel."""
    rows = face_normals(mesh, triangles(surface))
    p = [G.at(F.col("pts"), i) for i in range(3)]
    angles = [G.angle_between(G.sub(p[(i + 1) % 3], p[i]), G.sub(p[(i + 2) % 3], p[i])) for i in range(3)]
    spots = F.explode(F.array(*(F.struct(F.get("face", F.lit(i)).alias("nid"), a.alias("w")) for i, a in enumerate(angles)))).alias("s")
    sums = rows.select("normal", spots).groupBy("s.nid").agg(*(F.sum(F.col(f"normal.{c}") * F.col("s.w")).alias(c) for c in "xyz"))
    length = F.sqrt(sum((F.col(c) * F.col(c) for c in "xyz"), F.lit(0.0)))
    return sums.withColumn("_l", length).select("nid", *(F.when(F.col("_l") > 0, F.col(c) / F.col("_l")).otherwise(0.0).alias(c) for c in "xyz"))


def smoothness(mesh: Mesh, surface: DataFrame) -> DataFrame:
    """(nid, value): least dot of the adjacent faces' normals with that of the first (least eid, then key), in [0, 1]; 0 off the surface."""
    rows = face_normals(mesh, triangles(surface)).select("eid", "fkey", "normal", F.explode("face").alias("nid"))
    first = rows.groupBy("nid").agg(F.min_by("normal", F.struct("eid", "fkey")).alias("first"))
    value = rows.join(first, "nid").groupBy("nid").agg(F.greatest(F.min(G.dot(G.vec(F.col("first")), G.vec(F.col("normal")))), F.lit(0.0)).alias("value"))
    return mesh.nodes.select("nid").join(value, "nid", "left").select("nid", F.least(F.coalesce("value", F.lit(0.0)), F.lit(1.0)).alias("value"))


def sharp_edges(mesh: Mesh, surface: DataFrame, degrees: float) -> DataFrame:
    """(v1, v2): edges where a face's normal is off that of the first face (least eid, then key) by more than the angle."""
    edges = face_edges(surface).join(face_normals(mesh, surface).select("fkey", "normal"), "fkey")
    first = edges.groupBy("v1", "v2").agg(F.min_by("normal", F.struct("eid", "fkey")).alias("first"))
    sharp = F.min(F.abs(G.dot(G.vec(F.col("first")), G.vec(F.col("normal"))))) < math.cos(math.radians(degrees))
    return edges.join(first, ["v1", "v2"]).groupBy("v1", "v2").agg(sharp.alias("sharp")).filter("sharp").select("v1", "v2")


def line_interfaces(mesh: Mesh, surface: DataFrame, degrees: float = 0.0) -> DataFrame:
    """(v1, v2): edges of more than two faces, and with an angle also edges between two nodes of sharp edges."""
    edges = face_edges(surface)
    many = edges.groupBy("v1", "v2").agg(F.count("*").alias("n")).filter("n > 2").select("v1", "v2")
    if degrees <= 0:
        return many
    nodes = sharp_edges(mesh, surface, degrees).select(F.explode(F.array("v1", "v2")).alias("nid")).distinct()
    both = edges.select("v1", "v2").distinct().join(nodes.withColumnRenamed("nid", "v1"), "v1", "left_semi").join(nodes.withColumnRenamed("nid", "v2"), "v2", "left_semi")
    return many.unionByName(both.select("v1", "v2")).distinct()


def neighbours(surface: DataFrame, blocked: DataFrame | None = None) -> DataFrame:
    """(a, b): keys (hashed) of faces that share an edge which is not blocked."""
    return beside(surface, blocked).select("a", "b").distinct()


def beside(surface: DataFrame, blocked: DataFrame | None = None) -> DataFrame:
    """(a, b, place): the same, once for each edge, with a node of it."""
    edges = face_edges(surface)
    if blocked is not None:
        edges = edges.join(blocked, ["v1", "v2"], "left_anti")
    rows = edges.select("v1", "v2", F.xxhash64("fkey").alias("f"))
    other = rows.withColumnRenamed("f", "b")
    return rows.withColumnRenamed("f", "a").join(other, ["v1", "v2"]).filter("a <> b").select("a", "b", F.col("v1").alias("place"))


def patches(mesh: Mesh, surface: DataFrame, degrees: float | None = None) -> DataFrame:
    """The surface with ``patch``, the dense number of its edge-connected part, parts not joined over sharp edges."""
    blocked = sharp_edges(mesh, surface, degrees) if degrees is not None else None
    keyed = surface.withColumn("f", F.xxhash64("fkey"))
    parts = graph.components(beside(surface, blocked), keyed.select(F.col("f").alias("node")))
    least = vertices_of_part(keyed, parts)
    number = least.withColumn("patch", F.row_number().over(Window.orderBy("least", "component")) - 1)  # one row for each part
    return keyed.join(parts.withColumnRenamed("node", "f"), "f").join(number.select("component", "patch"), "component").select(*COLUMNS, F.col("patch").cast("long").alias("patch"))


def vertices_of_part(keyed: DataFrame, parts: DataFrame) -> DataFrame:
    return keyed.join(parts.withColumnRenamed("node", "f"), "f").groupBy("component").agg(F.min(F.struct(F.array_min("face"), "fkey")).alias("least"))


def restrict_by_seeds(mesh: Mesh, surface: DataFrame, seeds: list[tuple[float, float, float]], edge: float | None = None, angle: float | None = None, size: float | None = None, lower: float | None = None) -> DataFrame:
    """The part of a surface around seed coordinates.

    Seeds are the nearest surface nodes. ``edge``: flood over faces, not over sharp edges; ``angle``: flood over faces whose normal is
    within the angle of the seed face's; ``size`` (and ``lower``): faces with a node reached within the radius (but none within the lower)."""
    if edge is not None and angle is not None:
        raise ValueError("edge and angle exclude each other")
    if angle is not None and len(seeds) != 1:
        raise ValueError("an angle needs one seed")
    spark = surface.sparkSession
    points = spark.createDataFrame([(i, *map(float, s)) for i, s in enumerate(seeds)], "q long, x double, y double, z double")
    nodes = mesh.nodes.join(vertices(surface), "nid", "left_semi")
    from trellis.operators.spatial import nearest

    found = nearest(points, "q", nodes).select("q", "nid")
    out = surface
    keyed = surface.withColumn("f", F.xxhash64("fkey"))
    if edge is not None or angle is not None:
        start = keyed.select("f", F.explode("face").alias("nid")).join(found, "nid", "left_semi").select(F.col("f").alias("node")).distinct()
        if edge is not None:  # a flood that only edges stop fills whole parts
            parts = graph.components(beside(surface, sharp_edges(mesh, surface, edge)), keyed.select(F.col("f").alias("node")))
            reached = parts.join(parts.join(start, "node", "left_semi").select("component").distinct(), "component", "left_semi")
        else:
            normals = face_normals(mesh, surface).select(F.xxhash64("fkey").alias("f"), "normal")
            reference = normals.join(start, F.col("f") == F.col("node")).agg(F.min_by("normal", "f").alias("ref"))
            near = normals.crossJoin(F.broadcast(reference)).filter(G.dot(G.vec(F.col("ref")), G.vec(F.col("normal"))) > math.cos(math.radians(angle))).select("f")
            links = neighbours(surface).join(near.withColumnRenamed("f", "b"), "b", "left_semi").select("a", "b")
            reached = graph.reach(links, start)
        out = keyed.join(reached.withColumnRenamed("node", "f"), "f", "left_semi").select(*COLUMNS)
    for radius, keep in ((size, True), (lower, False)):
        if radius is not None:
            ball = found.join(nodes, "nid").select("q", F.col("x").alias("qx"), F.col("y").alias("qy"), F.col("z").alias("qz"))
            inside = nodes.crossJoin(F.broadcast(ball)).filter((F.col("x") - F.col("qx")) ** 2 + (F.col("y") - F.col("qy")) ** 2 + (F.col("z") - F.col("qz")) ** 2 < radius * radius).select("nid").distinct()
            hit = out.select("fkey", F.explode("face").alias("nid")).join(inside, "nid", "left_semi").select("fkey").distinct()
            out = out.join(hit, "fkey", "left_semi" if keep else "left_anti").select(*COLUMNS)
    return out


def orient(surface: DataFrame, mesh: Mesh, inward: bool = False) -> DataFrame:
    """A closed surface with every face turned so that its normal points outwards (or inwards): a point just off the
    face's centre is tested for being inside."""
    from trellis.operators.spatial import inside_surface

    rows = face_normals(mesh, surface).withColumn("q", F.xxhash64("fkey"))
    p = [G.at(F.col("pts"), i) for i in range(3)]
    least = F.least(*(F.sqrt(G.dist2(a, b)) for a, b in ((p[0], p[1]), (p[1], p[2]), (p[2], p[0]))))
    probe = G.plus(G.mean(p), G.scale(G.vec(F.col("normal")), 0.01 * least))
    probes = rows.select("q", *(c.alias(n) for c, n in zip(probe, "xyz")))
    found = inside_surface(probes, "q", mesh, triangles(surface))
    turn = F.col("inside") if not inward else ~F.col("inside")
    return rows.join(found, "q").withColumn("face", F.when(turn, F.reverse("face")).otherwise(F.col("face"))).select(*COLUMNS)


def curvature(mesh: Mesh, surface: DataFrame, rings: int) -> DataFrame:
    """(nid, value): 1 / radius of the sphere fitted to the nodes within ``rings`` edges on the surface; 0 where none fits."""
    edges = face_edges(triangles(surface)).select("v1", "v2").distinct()
    links = edges.unionByName(edges.select(F.col("v2").alias("v1"), F.col("v1").alias("v2")))
    patch = vertices(surface).select("nid", F.col("nid").alias("v1"))
    for _ in range(rings):
        patch = patch.unionByName(patch.join(links, "v1").select("nid", F.col("v2").alias("v1"))).distinct()
    spots = patch.join(mesh.nodes.withColumnRenamed("nid", "v1"), "v1")
    return fit_spheres(spots, "nid").select("nid", F.when(F.col("radius") > 0, 1.0 / F.col("radius")).otherwise(0.0).alias("value"))


def fit_spheres(points: DataFrame, key: str) -> DataFrame:
    """(key, cx, cy, cz, radius) of the least-squares sphere of each group; radius 0 where the system is singular.

    The normal equations |p|^2 = 2 c.p + k of points shifted by their mean are sums, so they are plain aggregates; the 3 x 3
    system is solved by Cramer's rule."""
    centre = points.groupBy(key).agg(*(F.avg(c).alias(f"m{c}") for c in "xyz"))
    d = {c: F.col(c) - F.col(f"m{c}") for c in "xyz"}
    r2 = d["x"] * d["x"] + d["y"] * d["y"] + d["z"] * d["z"]
    rows = points.join(centre, key)
    sums = rows.groupBy(key, "mx", "my", "mz").agg(F.count("*").alias("n"), F.avg(r2).alias("s"), *(F.sum(d[a] * d[b]).alias(a + b) for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")), *(F.sum(r2 * d[c]).alias(f"b{c}") for c in "xyz"))
    col = F.col
    m = [[col("xx"), col("xy"), col("xz")], [col("xy"), col("yy"), col("yz")], [col("xz"), col("yz"), col("zz")]]
    b = [col(f"b{c}") / 2.0 for c in "xyz"]
    det = lambda q: q[0][0] * (q[1][1] * q[2][2] - q[1][2] * q[2][1]) - q[0][1] * (q[1][0] * q[2][2] - q[1][2] * q[2][0]) + q[0][2] * (q[1][0] * q[2][1] - q[1][1] * q[2][0])
    whole = det(m)
    trace = col("xx") + col("yy") + col("zz")
    fine = F.abs(whole) > 1e-12 * trace * trace * trace
    c = [F.when(fine, G.ratio(det([[b[r] if k == j else m[r][k] for k in range(3)] for r in range(3)]), whole)) for j in range(3)]
    solved = sums.select(key, "mx", "my", "mz", "s", *(v.alias(f"c{n}") for v, n in zip(c, "xyz")))
    radius = F.sqrt(col("s") + col("cx") ** 2 + col("cy") ** 2 + col("cz") ** 2)
    return solved.select(key, *((col(f"c{n}") + col(f"m{n}")).alias(f"c{n}") for n in "xyz"), F.coalesce(radius, F.lit(0.0)).alias("radius"))




def split_list(mesh: Mesh, surface: DataFrame) -> DataFrame:
    """(elem, old, new) of a split along a surface: its nodes get new ids, in node order, in the elements on the owners' side.

    An element with a surface node is on that side if it is an owner or hangs together with one, over faces that are not of the surface,
    among the elements around the surface."""
    from trellis.model import dense_ids

    surface = cut(surface)
    nodes = vertices(surface)
    around = mesh.e2n.join(nodes, "nid", "left_semi").select("eid").distinct()
    near = mesh.with_elements(cut(mesh.elements.select("eid", "etype", "con").join(around, "eid", "left_semi")))  # who is on the side is among these
    faces = near.faces.join(surface.select("fkey"), "fkey", "left_anti").select("eid", "fkey")
    links = faces.select(F.col("eid").alias("a"), "fkey").join(faces.select(F.col("eid").alias("b"), "fkey"), "fkey").filter("a <> b").select("a", "b").distinct()
    side = graph.reach(links, surface.select(F.col("eid").alias("node")).distinct()).select(F.col("node").alias("eid"))
    fresh = dense_ids(nodes, "nid", "rank").crossJoin(F.broadcast(mesh.nodes.agg((F.max("nid") + 1).alias("top")))).select("nid", (F.col("top") + F.col("rank")).alias("new"))
    return near.e2n.join(side, "eid", "left_semi").join(fresh, "nid").select(F.col("eid").alias("elem"), F.col("nid").alias("old"), "new")
