"""Attributes of nodes and elements: gather, scatter, averages, gradients, transfer between meshes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.functions import geometry as G
from trellis.model import Mesh
from trellis.operators.spatial import correspondence
from trellis.operators.stats import volumes


def keyed(df: DataFrame) -> list[str]:
    """Columns besides idx and value that tell series apart, such as t."""
    return [c for c in df.columns if c not in ("idx", "value")]


def extract_data(data: DataFrame, mapping: DataFrame) -> DataFrame:
    """Gather: the values of the submesh's nodes or elements, under their own ids."""
    return data.join(mapping.select(F.col("mesh_idx").alias("idx"), "sub_idx"), "idx").select(*keyed(data), F.col("sub_idx").alias("idx"), "value")


def insert_data(sub: DataFrame, mapping: DataFrame, ids: DataFrame, old: DataFrame | None = None, default: float = 0.0) -> DataFrame:
    """Scatter: values of a submesh over those of the mesh (ids: idx), or over ``default`` without old data."""
    keys = keyed(sub)
    new = sub.withColumnRenamed("idx", "sub_idx").join(mapping.select("sub_idx", F.col("mesh_idx").alias("idx")), "sub_idx").select(*keys, "idx", F.col("value").alias("_new"))
    base = old if old is not None else (ids.select("idx").crossJoin(F.broadcast(sub.select(*keys).distinct())) if keys else ids.select("idx"))
    base = base if old is not None else base.withColumn("value", F.lit(default))
    return base.join(new, [*keys, "idx"], "left").select(*keys, "idx", F.coalesce("_new", "value").alias("value"))


def elem_to_node(mesh: Mesh, data: DataFrame, weighted: bool = True) -> DataFrame:
    """Mean of the adjacent elements' values, weighted by volume; 0 for nodes without elements or weight."""
    keys = keyed(data)
    rows = mesh.e2n.join(data.withColumnRenamed("idx", "eid"), "eid")
    if weighted:
        rows = rows.join(volumes(mesh).withColumnRenamed("value", "w"), "eid")
    w = F.col("w") if weighted else F.lit(1.0)
    sums = rows.groupBy(*keys, "nid").agg(F.sum(F.col("value") * w).alias("s"), F.sum(w).alias("w"))
    means = sums.select(*keys, F.col("nid").alias("idx"), F.when(F.col("w") != 0, F.col("s") / F.col("w")).otherwise(0.0).alias("value"))
    every = mesh.nodes.select(F.col("nid").alias("idx"))
    if keys:
        every = every.crossJoin(F.broadcast(data.select(*keys).distinct()))
    return every.join(means, [*keys, "idx"], "left").select(*keys, "idx", F.coalesce("value", F.lit(0.0)).alias("value"))


def node_to_elem(mesh: Mesh, data: DataFrame) -> DataFrame:
    """Plain mean over the element's nodes."""
    keys = keyed(data)
    rows = mesh.e2n.join(data.withColumnRenamed("idx", "nid"), "nid")
    return rows.groupBy(*keys, F.col("eid").alias("idx")).agg(F.avg("value").alias("value"))


def element_gradient(mesh: Mesh, data: DataFrame) -> DataFrame:
    """(idx, gx, gy, gz) of the linear function through a tetrahedron's nodal values; other types have no row."""
    values = mesh.e2n.join(data.withColumnRenamed("idx", "nid"), "nid").groupBy("eid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda p: p["value"]).alias("_f"))
    rows = mesh.points.filter("etype = 'Tt'").join(values, "eid")
    g = G.gradient_tet(F.col("pts"), F.col("_f"))
    return rows.select(F.col("eid").alias("idx"), *(c.alias(f"g{n}") for c, n in zip(g, "xyz")))


def extract_gradient(mesh: Mesh, data: DataFrame, nodal: bool = True) -> DataFrame:
    """(idx, gx, gy, gz, magnitude) at nodes (volume-weighted) or elements."""
    g = element_gradient(mesh, data)
    if nodal:
        rows = mesh.e2n.join(g.withColumnRenamed("idx", "eid"), "eid").join(volumes(mesh).withColumnRenamed("value", "w"), "eid")
        sums = rows.groupBy(F.col("nid").alias("idx")).agg(*((F.sum(F.col(f"g{c}") * F.col("w")) / F.sum("w")).alias(f"g{c}") for c in "xyz"))
        g = mesh.nodes.select(F.col("nid").alias("idx")).join(sums, "idx", "left").select("idx", *(F.coalesce(f"g{c}", F.lit(0.0)).alias(f"g{c}") for c in "xyz"))
    return g.withColumn("magnitude", F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy") + F.col("gz") * F.col("gz")))


def remap_known(mesh: Mesh, near: DataFrame) -> DataFrame:
    """(eid, near): the nearest nodes (nid, other) of each element's nodes, in order."""
    rows = mesh.e2n.join(near.select("nid", "other"), "nid").groupBy("eid").agg(F.array_sort(F.collect_list(F.struct("pos", "other"))).alias("s"))
    return rows.select("eid", F.transform("s", lambda s: s["other"]).alias("near"))


def insert_meshdata(mesh: Mesh, source: Mesh, what: str = "both", least_shared: int = 1) -> Mesh:
    """Tags and / or fibres from another mesh: an element takes those of the source element that most of its nodes' nearest nodes belong
    to (ties: least eid), if that is ``least_shared`` nodes or more."""
    near = correspondence(mesh, source)
    lists = remap_known(mesh, near)
    # an element with enough shared nodes has one among any but the last ``least_shared`` - 1 of its own
    probes = lists.select("eid", "near", F.explode(F.array_distinct(F.slice("near", 1, F.greatest(F.size("near") - least_shared + 1, F.lit(0))))).alias("other"))
    around = source.elements.select(F.col("eid").alias("src"), F.col("con").alias("_con"), F.explode(F.array_distinct("con")).alias("other"))
    both = F.filter("near", lambda n: F.array_contains("_con", n))
    hits = probes.join(around, "other").withColumn("_both", both).filter((F.size("_both") >= least_shared) & (F.get("_both", F.lit(0)) == F.col("other")))  # a pair counts at its first node
    best = hits.select("eid", "src", F.size("_both").alias("n")).groupBy("eid").agg(F.max_by("src", F.struct("n", -F.col("src"))).alias("src"))
    payload = source.elements.select(F.col("eid").alias("src"), F.col("tag").alias("_tag"), F.col("fib").alias("_fib"))
    out = mesh.elements.join(best.join(payload, "src"), "eid", "left")
    if what in ("tags", "both"):
        out = out.withColumn("tag", F.coalesce("_tag", "tag"))
    if what in ("fibres", "both"):
        out = out.withColumn("fib", F.coalesce("_fib", "fib"))
    return mesh.with_elements(out.select(*mesh.elements.columns))


def retag(mesh: Mesh, neighbours: int, shared: int, rounds: int = 100) -> Mesh:
    """Elements with fewer than ``neighbours`` others of their tag that share ``shared`` nodes or more take the tag most frequent among their
    node neighbours (ties: least tag), all at once, until none changes."""
    from trellis.session import cut

    mesh = mesh.with_elements(cut(mesh.elements))
    tags = mesh.elements.select("eid", "tag")
    for _ in range(rounds):
        rows = mesh.elements.drop("tag").join(tags, "eid").select("eid", "tag", "con", F.explode(F.array_distinct("con")).alias("nid"))
        other = rows.select(F.col("eid").alias("other"), F.col("tag").alias("t"), F.col("con").alias("_con"), "nid")
        # neighbours are voted on where they meet, at their first common node; only sums are shuffled
        pairs = rows.join(other, "nid").filter("eid <> other").withColumn("_both", F.array_intersect("con", "_con")).filter(F.get("_both", F.lit(0)) == F.col("nid"))
        sums = pairs.groupBy("eid", "t").agg(F.count("*").alias("v"), F.count_if((F.size("_both") >= shared) & (F.col("t") == F.col("tag"))).alias("same"))
        votes = sums.groupBy("eid").agg(F.sum("same").alias("same"), F.max_by("t", F.struct("v", -F.col("t"))).alias("top"))
        new = tags.join(votes, "eid", "left")
        new = cut(new.select("eid", F.when(F.coalesce("same", F.lit(0)) < neighbours, F.coalesce("top", "tag")).otherwise(F.col("tag")).alias("tag"), F.col("tag").alias("old")))
        tags = new.select("eid", "tag")
        if new.filter("tag <> old").isEmpty():
            break
    return mesh.with_elements(mesh.elements.drop("tag").join(tags, "eid").select(*mesh.elements.columns))


def simplify_tags(mesh: Mesh, largest: int) -> Mesh:
    """Face-connected islands of a tag with at most ``largest`` elements that are not the whole region take the tag most frequent over their
    faces with other tags (ties: least tag)."""
    from trellis.operators.graph import components

    faces = mesh.faces.select("eid", "fkey").join(mesh.elements.select("eid", "tag"), "eid")
    other = faces.select(F.col("eid").alias("b"), F.col("tag").alias("tb"), "fkey")
    pairs = faces.select(F.col("eid").alias("a"), F.col("tag").alias("ta"), "fkey").join(other, "fkey").filter("a <> b")
    parts = components(pairs.filter("ta = tb").select("a", "b"), mesh.elements.select(F.col("eid").alias("node")))
    labelled = mesh.elements.select("eid", "tag").join(parts.withColumnRenamed("node", "eid"), "eid")
    sizes = labelled.groupBy("component", "tag").agg(F.count("*").alias("n"))
    small = sizes.join(labelled.groupBy("tag").agg(F.count("*").alias("whole")), "tag").filter((F.col("n") <= largest) & (F.col("n") < F.col("whole"))).select("component")
    votes = pairs.filter("ta <> tb").join(labelled.select(F.col("eid").alias("a"), "component"), "a").groupBy("component", "tb").agg(F.count("*").alias("v"))
    top = votes.join(small, "component").groupBy("component").agg(F.max_by("tb", F.struct("v", -F.col("tb"))).alias("new"))
    tags = labelled.join(top, "component", "left").select("eid", F.coalesce("new", "tag").alias("tag"))
    return mesh.with_elements(mesh.elements.drop("tag").join(tags, "eid").select(*mesh.elements.columns))


def retag_by_image(mesh: Mesh, voxels: DataFrame, origin: tuple[float, float, float], spacing: tuple[float, float, float], table: dict[int, tuple[int, int]]) -> Mesh:
    """Elements whose centroid lies in a voxel of a label take the right tag where they have that label's wrong one. ``table``: label -> (wrong, right)."""
    spark = mesh.elements.sparkSession
    rules = spark.createDataFrame([(k, *v) for k, v in table.items()], "label long, wrong long, right long")
    cell = lambda c, k: F.floor((F.col("p")[c] - origin[k]) / spacing[k]).cast("int")
    centres = mesh.points.select("eid", "tag", G.barycenter(F.col("pts")).alias("p")).select("eid", "tag", *(cell(c, k).alias(n) for k, (c, n) in enumerate(zip("xyz", "ijk"))))
    hit = centres.join(voxels.select("i", "j", "k", F.col("value").cast("long").alias("label")), ["i", "j", "k"]).join(F.broadcast(rules), "label").filter("tag = wrong").select("eid", "right")
    return mesh.with_elements(mesh.elements.join(hit, "eid", "left").withColumn("tag", F.coalesce("right", "tag")).select(*mesh.elements.columns))


def volume_fractions(mesh: Mesh, surface_mesh: Mesh, samples: int = 4) -> DataFrame:
    """(eid, value): share of each tetrahedron inside a closed triangle mesh. All nodes inside: 1, none: 0; cut cells by a regular
    lattice of ``samples`` points along each edge, in place of clipping."""
    from trellis.operators.spatial import inside_surface

    faces = surface_mesh.elements.filter("etype = 'Tr'").select(F.col("con").alias("face"), F.array_sort("con").alias("fkey"))
    found = inside_surface(mesh.nodes, "nid", surface_mesh, faces)
    share = mesh.e2n.join(found, "nid").groupBy("eid").agg(F.avg(F.col("inside").cast("double")).alias("s"))
    cut_cells = mesh.points.join(share.filter("s > 0 and s < 1").select("eid"), "eid", "left_semi").filter("etype = 'Tt'")
    lattice = [((i + 0.25) / samples, (j + 0.25) / samples, (k + 0.25) / samples) for i in range(samples) for j in range(samples - i) for k in range(samples - i - j)]
    p = [G.at(F.col("pts"), i) for i in range(4)]
    spots = F.array(*(G.point(G.plus(G.plus(G.scale(p[0], 1 - a - b - c), G.scale(p[1], a)), G.plus(G.scale(p[2], b), G.scale(p[3], c)))) for a, b, c in lattice))
    probes = cut_cells.select("eid", F.posexplode(spots).alias("n", "s")).select(F.struct("eid", "n").alias("q"), "s.x", "s.y", "s.z")
    part = inside_surface(probes, "q", surface_mesh, faces).groupBy(F.col("q.eid").alias("eid")).agg(F.avg(F.col("inside").cast("double")).alias("part"))
    return share.join(part, "eid", "left").select("eid", F.coalesce("part", "s").alias("value"))

