"""Spatial joins by grid cells: nearest, k nearest, within a radius, containment.

Cells are equi-join keys, so Spark deals, and splits, the work; an exact filter follows. Searches for the nearest look in one ball, of the
size that suits where nodes are dense; queries that it does not settle go down a tree of cells, so a far query meets few nodes.
Ties go to the smaller node id.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trellis.functions import geometry as G
from trellis.model import FACES, Mesh
from trellis.operators.stats import ray_hit
from trellis.session import cut

AXES = "xyz"
RADIUS_CLASSES = 8
TOP_CELLS = 64
SENT_CELLS = 500_000


def extent(nodes: DataFrame) -> tuple[list[float], list[float], int]:
    row = nodes.agg(*(F.min(c) for c in AXES), *(F.max(c) for c in AXES), F.count("*")).first()
    if not row[6]:
        return [0.0] * 3, [0.0] * 3, 0
    return list(row[:3]), list(row[3:6]), row[6]


def cells(low: list[float], size: float | Column) -> list[Column]:
    return [F.floor((F.col(c) - F.lit(lo)) / F.lit(size)).alias(f"c{c}") for c, lo in zip(AXES, low)]


def covering(df: DataFrame, low: list[float], size: float | Column, ends: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Each row once for each cell of ``size`` that its box meets; ``ends``: least and greatest coordinate by axis."""
    for c, lo in zip(AXES, low):
        first, last = (F.floor((e - F.lit(lo)) / F.lit(size)) for e in ends[c])
        df = df.withColumn(f"c{c}", F.explode(F.sequence(first, last)))
    return df


def candidates(points: DataFrame, key: str, nodes: DataFrame, low: list[float], h: float | Column, by: tuple[str, ...] = ()) -> DataFrame:
    """(cx, cy, cz, key, nid, dist2) of all nodes within h of each point, and some others, of equal columns ``by``.

    Cells are 2 h wide: a node goes to the cells, 8 at most, that its ball of h meets, a point to its own one, so all that a point meets is in one place."""
    h = F.lit(h)
    reach = h * (1 + 1e-9) + F.greatest(*(F.abs(F.col(c)) for c in AXES)) * 1e-14
    placed = covering(nodes.select("nid", *by, *AXES), low, 2.0 * h, {c: (F.col(c) - reach, F.col(c) + reach) for c in AXES})
    placed = placed.select("nid", *by, "cx", "cy", "cz", *(F.col(c).alias(f"n{c}") for c in AXES))
    d2 = sum(((F.col(f"n{c}") - F.col(c)) * (F.col(f"n{c}") - F.col(c)) for c in AXES[1:]), (F.col("nx") - F.col("x")) * (F.col("nx") - F.col("x")))
    return points.select("*", *cells(low, 2.0 * h)).join(placed, [*by, "cx", "cy", "cz"]).select("cx", "cy", "cz", key, "nid", d2.alias("dist2"))


def first_radius(nodes: DataFrame, low: list[float], high: list[float], n: int, k: int) -> float:
    """A radius that holds rather more than k nodes where they are dense: by the box of the middle 80 % along each axis."""
    middle = nodes.agg(*(F.percentile_approx(c, [0.1, 0.9], 1000) for c in AXES)).first()
    whole = math.dist(low, high)
    spans = [q[1] - q[0] for q in middle if q[1] - q[0] > 1e-9 * whole]
    if not spans:
        return whole * min(1.0, k / n) ** (1 / 3) or 1.0
    d = len(spans)
    ball = (2.0, math.pi, math.pi * 4 / 3)[d - 1]
    return (math.prod(spans) / 0.8**d / n * (k + 3 * math.sqrt(k) + 1) / ball) ** (1 / d)


def k_nearest(points: DataFrame, key: str, nodes: DataFrame, k: int) -> DataFrame:
    """(key, rank, nid, dist2) of the k nodes nearest to each point (key, x, y, z); all, if there are fewer.

    Of nodes at one place only the k of least id can be among the nearest; the others take no part."""
    copies = F.row_number().over(Window.partitionBy(*AXES).orderBy("nid"))
    nodes = cut(nodes.select("nid", *AXES).withColumn("_copy", copies).filter(F.col("_copy") <= k).drop("_copy"))
    low, high, n = extent(nodes)
    points = points.select(key, *AXES)
    if not n:
        return points.select(key, F.lit(0).alias("rank"), F.lit(0).cast("long").alias("nid"), F.lit(0.0).alias("dist2")).limit(0)
    k_here = min(k, n)
    h = first_radius(nodes, low, high, n, k_here)
    own = Window.partitionBy("cx", "cy", "cz", key)  # a point's candidates are in its cell: no shuffle after the join
    near = candidates(points, key, nodes, low, h).filter(F.col("dist2") <= h * h)
    best = near.withColumn("rank", F.row_number().over(own.orderBy("dist2", "nid"))).filter(F.col("rank") <= k)
    settled = cut(best.withColumn("n", F.count("*").over(own)).filter(F.col("n") == k_here).select(key, "rank", "nid", "dist2"))
    rest = cut(points.join(settled.filter("rank = 1").select(key), key, "left_anti"))
    return settled if rest.isEmpty() else settled.unionByName(descent(rest, key, nodes, low, 2.0 * h, k_here))


def descent(points: DataFrame, key: str, nodes: DataFrame, low: list[float], size: float, k: int) -> DataFrame:
    """(key, rank, nid, dist2) of the k nearest (k nodes are there) by a tree of cells, each twice as wide as those below it.

    At each level a point keeps the cells whose boxes reach into the ball that surely holds k nodes, and goes down into these only; so a far
    point meets the nodes about its nearest ones, not all in a ball."""
    placed = nodes.select("nid", *(F.col(c).alias(f"n{c}") for c in AXES), *cells(low, size))
    box = [f(f"{n}{c}").alias(f"{n}{c}") for c in AXES for n, f in (("lo", F.min), ("hi", F.max))]
    first = [f(f"n{c}").alias(f"{n}{c}") for c in AXES for n, f in (("lo", F.min), ("hi", F.max))]
    tree = [cut(placed.groupBy("cx", "cy", "cz").agg(*first, F.count("*").alias("held")))]
    sizes = [tree[0].count()]
    while sizes[-1] > TOP_CELLS:
        wider = tree[-1].withColumns({f"c{c}": F.shiftright(f"c{c}", 1) for c in AXES}).groupBy("cx", "cy", "cz")
        tree.append(cut(wider.agg(*box, F.sum("held").alias("held"))))
        sizes.append(tree[-1].count())
    least, most = F.lit(0.0), F.lit(0.0)
    for c in AXES:
        below, above = F.col(f"lo{c}") - F.col(c), F.col(c) - F.col(f"hi{c}")
        gap, span = F.greatest(below, above, F.lit(0.0)), F.greatest(F.abs(below), F.abs(above))
        least, most = least + gap * gap, most + span * span
    mine = Window.partitionBy(key)
    held = F.sum("held").over(mine.orderBy("most").rowsBetween(Window.unboundedPreceding, 0))
    front = points.select(key, *AXES).repartition(F.col(key)).crossJoin(F.broadcast(tree[-1]))
    for level in range(len(tree) - 1, -1, -1):
        front = front.select(key, *AXES, "cx", "cy", "cz", "held", least.alias("least"), most.alias("most")).withColumn("sum", held)
        front = front.withColumn("bound", F.min(F.when(F.col("sum") >= k, F.col("most"))).over(mine)).filter(F.col("least") <= F.col("bound") * (1 + 1e-9))
        front = front.select(key, *AXES, "bound", *(F.col(f"c{c}").alias(f"p{c}" if level else f"c{c}") for c in AXES))
        if level:
            below = tree[level - 1].select("*", *(F.shiftright(f"c{c}", 1).alias(f"p{c}") for c in AXES))
            # points stay where they are while a level is small enough to be sent
            front = front.drop("bound").join(F.broadcast(below) if sizes[level - 1] <= SENT_CELLS else below, ["px", "py", "pz"])
    d2 = sum(((F.col(f"n{c}") - F.col(c)) * (F.col(f"n{c}") - F.col(c)) for c in AXES[1:]), (F.col("nx") - F.col("x")) * (F.col("nx") - F.col("x")))
    found = front.join(placed, ["cx", "cy", "cz"]).select(key, "nid", "bound", d2.alias("dist2")).filter(F.col("dist2") <= F.col("bound") * (1 + 1e-9))
    return cut(found.withColumn("rank", F.row_number().over(mine.orderBy("dist2", "nid"))).filter(F.col("rank") <= k).select(key, "rank", "nid", "dist2"))


def nearest(points: DataFrame, key: str, nodes: DataFrame) -> DataFrame:
    """(key, nid, dist2) of the node nearest to each point."""
    return k_nearest(points, key, nodes, 1).select(key, "nid", "dist2")


def correspondence(first: Mesh, second: Mesh) -> DataFrame:
    """(nid, other, dist2): for each node of the first mesh the nearest of the second, with the squared distance."""
    found = nearest(first.nodes.withColumnRenamed("nid", "q"), "q", second.nodes)
    return found.select(F.col("q").alias("nid"), F.col("nid").alias("other"), "dist2")


def within(points: DataFrame, key: str, nodes: DataFrame, radius: str | float, inclusive: bool = True) -> DataFrame:
    """(key, nid, dist2) of nodes within the radius (a number, or a column of ``points``) of each point; none for a null radius.

    Points go by the size of their radius: each class has cells a quarter as wide as the one before, so one wide query does not
    make the others read wide cells. Nodes are placed once for every class that occurs, ``RADIUS_CLASSES`` at most."""
    low, _, _ = extent(nodes)
    r = F.abs(F.col(radius)) if isinstance(radius, str) else F.lit(abs(float(radius)))
    most = points.agg(F.max(r)).first()[0] or 0.0
    h = max(most, 1e-300) * (1 + 1e-9) if most else 1.0
    step = F.when(r > 0, F.greatest(F.ceil(F.log2(r / h) / 2), F.lit(1 - RADIUS_CLASSES))).otherwise(F.lit(1 - RADIUS_CLASSES) if most else F.lit(0)).cast("int")
    points = points.select(F.struct(key, r.alias("_r")).alias("_k"), *AXES, step.alias("_step"))
    steps = sorted(points.agg(F.collect_set("_step")).first()[0])  # RADIUS_CLASSES at most
    nodes = nodes.select("nid", *AXES, F.explode(F.array(*(F.lit(i) for i in steps or [0]))).alias("_step"))
    found = candidates(points, "_k", nodes, low, F.lit(h * (1 + 1e-9)) * F.pow(F.lit(4.0), F.col("_step")), ("_step",))
    near = F.col("dist2") <= F.col("_k._r") * F.col("_k._r") if inclusive else F.col("dist2") < F.col("_k._r") * F.col("_k._r")
    return found.filter(near).select(F.col(f"_k.{key}").alias(key), "nid", "dist2")


def query_idx(mesh: Mesh, coordinate: tuple[float, float, float], radius: float = 0.0, subset: DataFrame | None = None) -> DataFrame:
    """(nid): nodes strictly within the radius of a coordinate; without a radius the nearest node. ``subset`` (nid) restricts the search."""
    nodes = mesh.nodes if subset is None else mesh.nodes.join(subset.select("nid").distinct(), "nid", "left_semi")
    x, y, z = (F.lit(float(c)) for c in coordinate)
    d2 = (F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y) + (F.col("z") - z) * (F.col("z") - z)
    if radius:
        return nodes.filter(d2 < radius * radius).select("nid")
    return nodes.agg(F.min(F.struct(d2.alias("d2"), "nid")).alias("m")).select("m.nid")


def query_idxlist(mesh: Mesh, queries: DataFrame) -> DataFrame:
    """(q, ids): for each query (q, x, y, z, thr) the nodes within thr (inclusive), by distance then id; the nearest node if thr is 0."""
    ball = within(queries.filter("thr <> 0"), "q", mesh.nodes, "thr")
    single = nearest(queries.filter("thr = 0"), "q", mesh.nodes)
    rows = ball.unionByName(single).groupBy("q").agg(F.transform(F.array_sort(F.collect_list(F.struct("dist2", "nid"))), lambda s: s["nid"]).alias("ids"))
    return queries.select("q").join(rows, "q", "left").select("q", F.coalesce("ids", F.array().cast("array<bigint>")).alias("ids"))


def uvc_clouds(uvc: DataFrame) -> DataFrame:
    """(nid, side, x, y, z): points (rho, phi, z) of ventricular coordinates (nid, z, rho, phi, v), left where v > 0; points within
    a twentieth of the turn at +-pi appear again, a turn away."""
    base = uvc.select("nid", F.when(F.col("v") > 0, "left").otherwise("right").alias("side"), F.col("rho").alias("x"), F.col("phi").alias("y"), F.col("z").alias("z"))
    edge = math.pi * 0.95
    wrap = base.filter(F.abs("y") > edge).withColumn("y", F.col("y") - F.signum("y") * 2.0 * math.pi)
    return base.unionByName(wrap)


def query_idxlist_uvc(mesh: Mesh, uvc: DataFrame, queries: DataFrame) -> DataFrame:
    """(q, ids): for (q, z, rho, phi, v, thr, eps) the node nearest in ventricular coordinates, then nodes of its side within thr of it
    whose rho differs by less than eps (no limit if eps <= 0)."""
    clouds = uvc_clouds(uvc)
    probe = queries.select("q", F.when(F.col("v") > 0, "left").otherwise("right").alias("side"), F.col("rho").alias("x"), F.col("phi").alias("y"), "z")
    hits = None
    for side in ("left", "right"):
        found = nearest(probe.filter(F.col("side") == side), "q", clouds.filter(F.col("side") == side)).select("q", F.col("nid").alias("hit"))
        found = found.withColumn("side", F.lit(side))
        hits = found if hits is None else hits.unionByName(found)
    info = uvc.select("nid", "rho", F.when(F.col("v") > 0, "left").otherwise("right").alias("side"))
    centres = cut(hits.join(mesh.nodes.withColumnRenamed("nid", "hit"), "hit").join(info.select(F.col("nid").alias("hit"), F.col("rho").alias("rho0")), "hit").join(queries.select("q", "thr", "eps"), "q"))
    ball = within(centres, "q", mesh.nodes, "thr").join(centres.select("q", F.col("side").alias("side0"), "rho0", "eps"), "q").join(info, "nid")
    kept = ball.filter((F.col("side") == F.col("side0")) & ((F.col("eps") <= 0) | (F.abs(F.col("rho") - F.col("rho0")) < F.col("eps"))))
    rows = kept.groupBy("q").agg(F.transform(F.array_sort(F.collect_list(F.struct("dist2", "nid"))), lambda s: s["nid"]).alias("ids"))
    return queries.select("q").join(rows, "q", "left").select("q", F.coalesce("ids", F.array().cast("array<bigint>")).alias("ids"))


def extract_overlap(first: Mesh, second: Mesh, size: float = 2.0, complement: bool = False) -> DataFrame:
    """(eid) of the first mesh's elements with a node within ``size`` mean edge lengths of a node of the second."""
    from trellis.operators.stats import average_edge_length

    edge = average_edge_length(first).first()["mean"]
    near = within(second.nodes.withColumnRenamed("nid", "q"), "q", first.nodes, size * edge).select("nid").distinct()
    hit = first.e2n.join(near, "nid", "left_semi").select("eid").distinct()
    return first.elements.select("eid").join(hit, "eid", "left_anti") if complement else hit


def weights(etype: Column, pts: Column, p: G.Vec, types: list[str]) -> Column:
    """Interpolation weights of a point in an element, by node: barycentric in tetrahedra and (projected) triangles, squared
    inverse distances else; null if the point is not inside. Only ``types`` are looked for."""
    slack = -1e-9
    spots = F.struct(*(G.point(v).alias(n) for n, v in (("p", p), *((f"a{i}", G.at(pts, i)) for i in range(4)))))

    def volumes(r: Column) -> Column:
        o, *a = (G.vec(r[n]) for n in ("p", "a0", "a1", "a2", "a3"))
        parts = (G.signed_tet_volume(*(o if k == i else v for k, v in enumerate(a))) for i in range(4))
        return F.struct(G.signed_tet_volume(*a).alias("whole"), *(v.alias(f"v{i}") for i, v in enumerate(parts)))

    # each step's values are computed once: written out, the formula is too long for the compiler and for the tasks that carry it
    tet = lambda r: F.array(*(G.ratio(r[f"v{i}"], r["whole"]) for i in range(4)))
    flat = G.let(G.let(G.let(spots, volumes), tet), lambda w: F.when(F.array_min(w) >= slack, w))
    tri = G.let(G.let(spots, lambda r: F.array(*G.barycentric_triangle(*(G.vec(r[n]) for n in ("p", "a0", "a1", "a2"))))), lambda w: F.when(F.array_min(w) >= slack, w))
    centre = G.vec(G.barycenter(pts))
    solid = F.lit(False)
    for name in (n for n in ("Hx", "Pr", "Py") if n in types):
        inside = F.lit(True)
        for face in FACES[name]:
            o, u, v = (G.at(pts, i) for i in face[:3])
            side = lambda q: G.plane_side(q, o, u, v)  # noqa: B023, E731
            inside = inside & (side(p) * side(centre) >= slack)
        solid = F.when(etype == name, inside).otherwise(solid)
    inverse = F.transform(pts, lambda q: 1.0 / F.greatest(G.dist2(G.vec(q), p), F.lit(1e-300)))
    total = F.aggregate(inverse, F.lit(0.0), lambda s, w: s + w)
    known = {"Tt": flat, "Tr": tri}
    out = F.when(F.lit(False), flat)
    for name in (n for n in known if n in types):
        out = out.when(etype == name, known[name])
    return out.when(solid, F.transform(inverse, lambda w: w / total)) if {"Hx", "Pr", "Py"} & set(types) else out


def containing(points: DataFrame, key: str, mesh: Mesh) -> DataFrame:
    """(key, eid, con, w): for each point all elements that hold it, with the interpolation weights of their nodes.

    Elements go by size: those of a level, twice as large as those of the one before, have cells twice as wide and cover 8 of them at most, and
    points have one cell at each level that occurs."""
    low, _, _ = extent(mesh.nodes)
    ends = {f"{n}{c}": f(F.transform("pts", G.part(c))) for c in AXES for n, f in (("lo", F.array_min), ("hi", F.array_max))}
    boxes = cut(mesh.points.select("eid", "etype", "con", "pts", *(v.alias(k) for k, v in ends.items())))
    widest = F.greatest(*(F.col(f"hi{c}") - F.col(f"lo{c}") for c in AXES))
    mean, types = boxes.agg(F.avg(widest), F.collect_set("etype")).first()
    h = 2.0 * (mean or 1.0)
    pad = F.lit(1e-9 * h)
    boxes = boxes.withColumn("level", F.when(widest > h, F.ceil(F.log2(widest / h))).otherwise(0).cast("int"))
    levels = sorted(boxes.agg(F.collect_set("level")).first()[0])  # as many as doublings from the mean to the largest element
    size = F.lit(h) * F.pow(F.lit(2.0), F.col("level"))
    boxes = boxes.select("*", *(f.alias(n) for c in AXES for n, f in ((f"_lo{c}", F.col(f"lo{c}") - pad), (f"_hi{c}", F.col(f"hi{c}") + pad)))).drop(*ends)
    boxes = covering(boxes, low, size, {c: (F.col(f"_lo{c}"), F.col(f"_hi{c}")) for c in AXES})
    placed = points.select(key, *AXES, F.explode(F.array(*(F.lit(n) for n in levels or [0]))).alias("level"))
    inside = placed.select("*", *cells(low, size)).join(boxes, ["level", "cx", "cy", "cz"])
    for c in AXES:
        inside = inside.filter(F.col(c).between(F.col(f"_lo{c}"), F.col(f"_hi{c}")))
    w = weights(F.col("etype"), F.col("pts"), tuple(F.col(c) for c in AXES), types)
    return inside.select(key, "eid", "con", w.alias("w")).filter("w is not null")


def enclosing(points: DataFrame, key: str, mesh: Mesh) -> DataFrame:
    """(key, eid, con, w): for each point in an element the one of least eid, with the interpolation weights of its nodes."""
    return containing(points, key, mesh).groupBy(key).agg(F.min_by(F.struct("eid", "con", "w"), "eid").alias("s")).select(key, "s.eid", "s.con", "s.w")


# three directions off all axes and planes of symmetry, so that rays rarely meet edges
RAYS = ((0.5773, 0.6113, 0.5411), (-0.6427, 0.3391, 0.6871), (0.2791, -0.8231, 0.4947))


def along(axis: tuple[float, float, float]):
    """A point's coordinate along an axis."""
    return lambda p: p["x"] * axis[0] + p["y"] * axis[1] + p["z"] * axis[2]


def inside_surface(points: DataFrame, key: str, mesh: Mesh, faces: DataFrame) -> DataFrame:
    """(key, inside) of points and a closed triangle surface (fkey, face): majority over three fixed rays of the parity of hits.

    Each ray's direction is an axis of its own grid: triangles cover cells of the plane across it, a point has one cell."""
    from trellis.model import with_points

    tris = with_points(faces.select("face", F.xxhash64("fkey").alias("fid")), "face", "fid", mesh.nodes).select("fid", "pts")
    h = tris.agg(F.avg(F.sqrt(G.dist2(G.at(F.col("pts"), 0), G.at(F.col("pts"), 1))))).first()[0] or 1.0
    hits = None
    for n, d in enumerate(RAYS):
        size = math.sqrt(sum(c * c for c in d))
        d = tuple(c / size for c in d)
        u = (d[1], -d[0], 0.0)
        size = math.hypot(*u)
        u = tuple(c / size for c in u)
        v = (d[1] * u[2] - d[2] * u[1], d[2] * u[0] - d[0] * u[2], d[0] * u[1] - d[1] * u[0])
        cell = lambda value: F.floor(value / h)
        flat = tris
        for name, axis in (("cu", u), ("cv", v)):
            spots = F.transform("pts", along(axis))
            flat = flat.withColumn(name, F.explode(F.sequence(cell(F.array_min(spots)), cell(F.array_max(spots)))))
        p = tuple(F.col(c) for c in AXES)
        rays = points.select(key, *AXES, cell(along(u)(F.struct(*AXES))).alias("cu"), cell(along(v)(F.struct(*AXES))).alias("cv"))
        t = ray_hit(p, tuple(F.lit(c) for c in d), F.col("pts"))
        found = rays.join(flat, ["cu", "cv"]).withColumn("t", t).filter("t > 0").select(key, F.lit(n).alias("ray"), "fid").distinct()
        hits = found if hits is None else hits.unionByName(found)
    odd = hits.groupBy(key, "ray").agg((F.count("*") % 2).alias("odd")).groupBy(key).agg(F.sum("odd").alias("votes"))
    return points.select(key).join(odd, key, "left").select(key, (F.coalesce("votes", F.lit(0)) >= 2).alias("inside"))


def query_insidepoint(mesh: Mesh) -> DataFrame:
    """(x, y, z) of a point inside a closed triangle mesh: from the triangle of least id whose point a hundredth of its least edge inwards is inside."""
    p = [G.at(F.col("pts"), i) for i in range(3)]
    least = F.least(*(F.sqrt(G.dist2(a, b)) for a, b in ((p[0], p[1]), (p[1], p[2]), (p[2], p[0]))))
    normal = G.triangle_normal(*p)
    spots = [mesh.points.filter("etype = 'Tr'").select((F.col("eid") * 2 + k).alias("q"), *(c.alias(n) for c, n in zip(G.plus(G.mean(p), G.scale(normal, s * least)), AXES))) for k, s in ((0, -0.01), (1, 0.01))]
    probes = spots[0].unionByName(spots[1])
    faces = mesh.elements.filter("etype = 'Tr'").select(F.col("con").alias("face"), F.array_sort("con").alias("fkey"))
    return probes.join(inside_surface(probes, "q", mesh, faces).filter("inside"), "q").agg(F.min_by(F.struct(*AXES), "q").alias("p")).select("p.*")


def sample_tags(mesh: Mesh, surface_mesh: Mesh, tag: int, by_nodes: bool = True) -> DataFrame:
    """(eid, tag): elements inside a closed triangle mesh get ``tag``: those with all nodes inside, or with their centroid inside."""
    faces = surface_mesh.elements.filter("etype = 'Tr'").select(F.col("con").alias("face"), F.array_sort("con").alias("fkey"))
    if by_nodes:
        found = inside_surface(mesh.nodes, "nid", surface_mesh, faces)
        hit = mesh.e2n.join(found, "nid").groupBy("eid").agg(F.min(F.col("inside").cast("int")).alias("i"))
    else:
        centres = mesh.points.select("eid", G.barycenter(F.col("pts")).alias("p")).select("eid", "p.x", "p.y", "p.z")
        hit = inside_surface(centres, "eid", surface_mesh, faces).select("eid", F.col("inside").cast("int").alias("i"))
    return mesh.elements.select("eid", "tag").join(hit, "eid", "left").select("eid", F.when(F.col("i") == 1, F.lit(tag)).otherwise(F.col("tag")).cast("long").alias("tag"))
