"""Voxel images: sparse or dense tables (i, j, k, value) with a header of dimensions, origin and spacing. Absent voxels are 0."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.session import cut

# fixed values: numeric types by id
TYPES = {1: "tinyint", 2: "tinyint", 3: "smallint", 4: "smallint", 5: "int", 6: "int", 7: "bigint", 8: "bigint", 9: "float", 10: "double"}
UNSIGNED = {1: 8, 3: 16, 5: 32}


@dataclass(frozen=True)
class Image:
    voxels: DataFrame
    dim: tuple[int, int, int]
    origin: tuple[float, float, float] = (0.0, 0.0, 0.0)
    spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)
    dtype: int = 10


AXES = ("i", "j", "k")


def dtype(image: Image, kind: int) -> Image:
    """Cast as C does: to whole numbers toward zero, wrapping at the type's width."""
    value = F.col("value")
    if kind in (9, 10):
        out = value.cast(TYPES[kind]).cast("double")
    else:
        bits = UNSIGNED.get(kind, {2: 8, 4: 16, 6: 32, 7: 64, 8: 64}[kind] if kind in (2, 4, 6, 7, 8) else 64)
        whole = value.cast("bigint")
        if bits < 64:
            whole = F.pmod(whole, F.lit(1 << bits))
            if kind not in UNSIGNED:
                whole = F.when(whole >= (1 << (bits - 1)), whole - (1 << bits)).otherwise(whole)
        out = whole.cast("double")
    return replace(image, voxels=image.voxels.withColumn("value", out), dtype=kind)


def flip(image: Image, axes: str) -> Image:
    v = image.voxels
    for c, n, name in zip(AXES, image.dim, "xyz"):
        if name in axes:
            v = v.withColumn(c, F.lit(n - 1) - F.col(c))
    return replace(image, voxels=v)


def pad(image: Image, size: tuple[int, int, int]) -> Image:
    v = image.voxels.select(*((F.col(c) + s).alias(c) for c, s in zip(AXES, size)), "value")
    return replace(image, voxels=v, dim=tuple(n + 2 * s for n, s in zip(image.dim, size)), origin=tuple(o - s * h for o, s, h in zip(image.origin, size, image.spacing)))


def bounding_box(image: Image) -> DataFrame:
    return image.voxels.filter("value <> 0").agg(*(f(c).alias(f"{n}_{c}") for c in AXES for n, f in (("min", F.min), ("max", F.max))))


def crop(image: Image, factor: int = 1) -> Image:
    """The box of the non-zero voxels, then refined."""
    row = bounding_box(image).first()
    if row["min_i"] is None:
        return replace(image, voxels=image.voxels.limit(0), dim=(0, 0, 0))
    low = [row[f"min_{c}"] for c in AXES]
    high = [row[f"max_{c}"] for c in AXES]
    v = image.voxels
    for c, lo, hi in zip(AXES, low, high):
        v = v.filter(F.col(c).between(lo, hi)).withColumn(c, F.col(c) - lo)
    out = replace(image, voxels=v, dim=tuple(h - lo + 1 for lo, h in zip(low, high)), origin=tuple(o + lo * s for o, lo, s in zip(image.origin, low, image.spacing)))
    return refine(out, (factor,) * 3) if factor > 1 else out


def refine(image: Image, factor: tuple[int, int, int]) -> Image:
    """Each voxel becomes a block of equal ones."""
    v = image.voxels
    for c, s in zip(AXES, factor):
        v = v.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(s - 1)))).withColumn(c, (F.col(c) * s + F.col("_s")).cast("int")).drop("_s")
    return replace(image, voxels=v, dim=tuple(n * s for n, s in zip(image.dim, factor)), spacing=tuple(h / s for h, s in zip(image.spacing, factor)))


def normalize(image: Image, size: float | None = None) -> Image:
    """The same spacing on all axes (by default the least), by the nearest voxel."""
    h = size or min(image.spacing)
    dim = tuple(max(1, int(n * s / h)) for n, s in zip(image.dim, image.spacing))
    v = image.voxels
    for c, n, s in zip(AXES, dim, image.spacing):
        # new index x reads floor((x + 1/2) h / s): each old voxel lists the new ones that read it
        r = F.sequence(F.greatest(F.floor(F.col(c) * s / h - 0.5), F.lit(0)), F.ceil((F.col(c) + 1) * s / h - 0.5))
        v = v.withColumn("_n", F.explode(r)).filter((F.floor((F.col("_n") + 0.5) * h / s) == F.col(c)) & (F.col("_n") < n)).withColumn(c, F.col("_n").cast("int")).drop("_n")
    return replace(image, voxels=v, dim=dim, spacing=(h, h, h))


def slices(image: Image, plane: str, indices: list[int]) -> Image:
    """Slices of a plane (xy, xz or yz), stacked in ascending order of the index."""
    axis = {"xy": "k", "xz": "j", "yz": "i"}[plane]
    order = {n: r for r, n in enumerate(sorted(set(indices)))}
    table = F.create_map(*(F.lit(x) for pair in order.items() for x in pair)) if order else F.create_map()
    v = image.voxels.filter(F.col(axis).isin(list(order))).withColumn(axis, F.element_at(table, F.col(axis)).cast("int"))
    n = AXES.index(axis)
    return replace(image, voxels=v, dim=tuple(len(order) if i == n else d for i, d in enumerate(image.dim)))


def shift(image: Image, by: tuple[int, int, int]) -> Image:
    """Cyclic offset."""
    return replace(image, voxels=image.voxels.select(*(F.pmod(F.col(c) + s, F.lit(n)).cast("int").alias(c) for c, s, n in zip(AXES, by, image.dim)), "value"))


def stencil(radius: tuple[float, float, float]) -> list[tuple[int, int, int]]:
    """Offsets in an ellipsoid."""
    out = []
    for a in range(-int(radius[0]), int(radius[0]) + 1):
        for b in range(-int(radius[1]), int(radius[1]) + 1):
            for c in range(-int(radius[2]), int(radius[2]) + 1):
                if sum((x / r) ** 2 if r else (0.0 if x == 0 else 2.0) for x, r in zip((a, b, c), radius)) <= 1.0 + 1e-12:
                    out.append((a, b, c))
    return out


def spread(image: Image, voxels: DataFrame, offsets: list[tuple[int, int, int]]) -> DataFrame:
    """Each voxel at all places in the image that see it through the offsets, with its own value."""
    where = F.explode(F.array(*(F.struct(*(F.lit(x).alias(n) for x, n in zip(o, "abc"))) for o in offsets)))
    v = voxels.withColumn("_o", where).select(*((F.col(c) + F.col(f"_o.{n}")).alias(c) for c, n in zip(AXES, "abc")), "value")
    for c, n in zip(AXES, image.dim):
        v = v.filter(F.col(c).between(0, n - 1))
    return v


def box(image: Image, radius: tuple[int, int, int]) -> list[tuple[int, int]]:
    """Reach along each axis: whole voxels of the radius, which is in units of the first axis' spacing."""
    return [int(r * image.spacing[0] / h) for r, h in zip(radius, image.spacing)]


def dilate(image: Image, places: DataFrame, radius: tuple[int, int, int] = (1, 1, 1)) -> DataFrame:
    """Places (i, j, k) of the image that have one of ``places`` in their box; an axis at a time."""
    for c, r, n in zip(AXES, box(image, radius), image.dim):
        near = F.explode(F.sequence(F.greatest(F.col(c) - r, F.lit(0)), F.least(F.col(c) + r, F.lit(n - 1))))
        places = places.withColumn(c, near).distinct()
    return places.select(*AXES)


def erode(image: Image, places: DataFrame, radius: tuple[int, int, int] = (1, 1, 1)) -> DataFrame:
    """Those of ``places`` whose box, as far as it lies in the image, is all of ``places``; an axis at a time."""
    for c, r, n in zip(AXES, box(image, radius), image.dim):
        near = F.sequence(F.greatest(F.col(c) - r, F.lit(0)), F.least(F.col(c) + r, F.lit(n - 1)))
        full = F.least(F.col(c) + r, F.lit(n - 1)) - F.greatest(F.col(c) - r, F.lit(0)) + 1
        others = [x for x in AXES if x != c]
        seen = places.select(*others, F.explode(near).alias(c)).groupBy(*AXES).agg(F.count("*").alias("n"))
        places = seen.filter(F.col("n") == full).select(*AXES)
    return places


def close(image: Image, tags: list[int], radius: tuple[int, int, int] = (1, 1, 1), rounds: int = 1) -> Image:
    """For each tag in turn, on its own voxels: ``rounds`` times dilate, then erode, by a box clipped to the image; what the tag
    then covers takes its value, other tags included."""
    v = cut(image.voxels.filter("value <> 0"))
    for tag in tags:
        own = v.filter(F.col("value") == tag).select(*AXES)
        for _ in range(rounds):
            own = cut(erode(image, dilate(image, own, radius), radius))
        rest = v.filter(F.col("value") != tag).join(own, list(AXES), "left_anti")
        v = cut(rest.select(*AXES, "value").unionByName(own.select(*AXES, F.lit(float(tag)).cast(v.schema["value"].dataType).alias("value"))))
    return replace(image, voxels=v)


def smooth(image: Image, radius: tuple[float, float, float] = (1, 1, 1), rate: float = 0.15, rounds: int = 100, clamp: bool = True) -> Image:
    """Taubin pairs over an ellipsoid, then each voxel takes the value nearest to its own (ties: least) among the original values around it. Needs a dense image."""
    offsets = stencil(radius)
    start = cut(image.voxels)
    v = start
    for n in range(2 * rounds):
        s = rate if n % 2 == 0 else -1.04 * rate
        mean = spread(image, v, offsets).groupBy(*AXES).agg(F.avg("value").alias("m"))
        v = v.join(mean, list(AXES)).select(*AXES, (F.col("value") + s * (F.col("m") - F.col("value"))).alias("value"))
        if n % 4 == 3:
            v = cut(v)
    if clamp:
        around = spread(image, start, offsets).withColumnRenamed("value", "r")
        v = v.join(around, list(AXES)).groupBy(*AXES).agg(F.min_by("r", F.struct(F.abs(F.col("r") - F.col("value")), "r")).alias("value"))
    return replace(image, voxels=v)


def sample(spark, low: tuple[float, float, float], spacing: tuple[float, float, float], dim: tuple[int, int, int], mesh, tag: int = 1) -> Image:
    """An image whose voxels are ``tag`` where their centre is inside a closed triangle mesh."""
    from trellis.operators.spatial import inside_surface

    n = dim[0] * dim[1] * dim[2]
    grid = spark.range(n).select("id", (F.col("id") % dim[0]).cast("int").alias("i"), (F.floor(F.col("id") / dim[0]) % dim[1]).cast("int").alias("j"), F.floor(F.col("id") / (dim[0] * dim[1])).cast("int").alias("k"))
    centres = grid.select("id", *((low[a] + (F.col(c) + 0.5) * spacing[a]).alias(x) for a, (c, x) in enumerate(zip(AXES, "xyz"))))
    faces = mesh.elements.filter("etype = 'Tr'").select(F.col("con").alias("face"), F.array_sort("con").alias("fkey"))
    found = inside_surface(centres, "id", mesh, faces)
    return Image(grid.join(found, "id").select(*AXES, F.when(F.col("inside"), float(tag)).otherwise(0.0).alias("value")), dim, low, spacing, 4)


def mask(image: Image, where: Image) -> Image:
    """Zero where the other image is zero or has no voxel."""
    return replace(image, voxels=image.voxels.join(where.voxels.filter("value <> 0").select(*AXES), list(AXES), "left_semi"))


def extract_values(image: Image, places: DataFrame) -> DataFrame:
    """(i, j, k, value) at places (i, j, k); 0 where there is no voxel."""
    return places.select(*AXES).join(image.voxels, list(AXES), "left").select(*AXES, F.coalesce("value", F.lit(0.0)).alias("value"))


def insert_values(image: Image, values: DataFrame) -> Image:
    """Values (i, j, k, value) over those of the image."""
    new = values.select(*AXES, F.col("value").alias("_new"))
    v = image.voxels.join(new, list(AXES), "full").select(*AXES, F.coalesce("_new", "value").alias("value"))
    return replace(image, voxels=v)


def set_value(image: Image, places: DataFrame, value: float) -> Image:
    return insert_values(image, places.select(*AXES).withColumn("value", F.lit(float(value))))


def voxel_mesh(image: Image):
    """Voxels of non-zero value as a hexahedral mesh: nodes are the lattice points, tag = value."""
    from trellis.model import Mesh

    nx, ny = image.dim[0] + 1, image.dim[1] + 1
    at = lambda a, b, c: ((F.col("i") + a) + (F.col("j") + b) * nx + (F.col("k") + c) * nx * ny).cast("long")
    eid = (F.col("i") + F.col("j") * image.dim[0] + F.col("k") * image.dim[0] * image.dim[1]).cast("long")
    # the native order: 0-1-2-3 below, 4-7-6-5 above 0-1-2-3
    con = F.array(at(0, 0, 0), at(1, 0, 0), at(1, 1, 0), at(0, 1, 0), at(0, 0, 1), at(0, 1, 1), at(1, 1, 1), at(1, 0, 1))
    elements = image.voxels.filter("value <> 0").select(eid.alias("eid"), F.lit("Hx").alias("etype"), con.alias("con"), F.col("value").cast("long").alias("tag"), F.array().cast("array<double>").alias("fib"))
    ids = elements.select(F.explode("con").alias("nid")).distinct()
    spot = [F.col("nid") % nx, F.floor(F.col("nid") / nx) % ny, F.floor(F.col("nid") / (nx * ny))]
    return Mesh(ids.select("nid", *((o + s * h).alias(c) for o, s, h, c in zip(image.origin, spot, image.spacing, "xyz"))), elements)
