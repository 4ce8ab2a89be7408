"""Geometry as Column expressions over points (struct<x,y,z>) and arrays of points."""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from trellis.model import FACES

Vec = tuple[Column, Column, Column]


def vec(p: Column) -> Vec:
    return p["x"], p["y"], p["z"]


def point(v: Vec) -> Column:
    return F.struct(*(c.alias(n) for c, n in zip(v, "xyz")))


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(p - q for p, q in zip(a, b))


def plus(a: Vec, b: Vec) -> Vec:
    return tuple(p + q for p, q in zip(a, b))


def scale(a: Vec, s) -> Vec:
    return tuple(p * s for p in a)


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def dist2(a: Vec, b: Vec) -> Column:
    d = sub(a, b)
    return dot(d, d)


def mean(vs: list[Vec]) -> Vec:
    return tuple(reduce(add, c) / len(vs) for c in zip(*vs))


def at(pts: Column, i: int) -> Vec:
    return vec(F.get(pts, F.lit(i)))


def part(name: str):
    return lambda p: p[name]


def barycenter(pts: Column) -> Column:
    """Mean of any number of points."""
    n = F.size(pts)
    return F.struct(*((F.aggregate(F.transform(pts, part(c)), F.lit(0.0), lambda s, v: s + v) / n).alias(c) for c in "xyz"))


def signed_tet_volume(a: Vec, b: Vec, c: Vec, d: Vec) -> Column:
    return dot(cross(sub(b, a), sub(c, a)), sub(d, a)) / 6.0


def triangle_area(a: Vec, b: Vec, c: Vec) -> Column:
    return 0.5 * norm(cross(sub(b, a), sub(c, a)))


def signed_triangle_area(a: Vec, b: Vec, c: Vec) -> Column:
    """Area of a triangle's shadow in the x-y plane, positive if it runs counter-clockwise there."""
    return 0.5 * ((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]))


def triangle_normal(a: Vec, b: Vec, c: Vec) -> Vec:
    """Unit normal that points out of an element whose faces are clockwise seen from outside; zero if degenerate."""
    n = cross(sub(c, a), sub(b, a))
    length = norm(n)
    return tuple(F.when(length > 0, p / length).otherwise(F.lit(0.0)) for p in n)


def fan_area(vs: list[Vec]) -> Column:
    centre = mean(vs)
    return reduce(add, (triangle_area(centre, a, b) for a, b in zip(vs, vs[1:] + vs[:1])))


def hull_volume(vs: list[Vec], faces: list[tuple[int, ...]]) -> Column:
    """Volume of a cell: tetrahedra from its centre to its faces, quadrilaterals about their own centres."""
    centre = mean(vs)
    parts = []
    for face in faces:
        ring = [vs[i] for i in face]
        if len(ring) == 3:
            parts.append(signed_tet_volume(centre, *ring))
        else:
            middle = mean(ring)
            parts += [signed_tet_volume(centre, middle, a, b) for a, b in zip(ring, ring[1:] + ring[:1])]
    return F.abs(reduce(add, parts))


def volume(etype: Column, pts: Column) -> Column:
    """Length, area or volume by element type."""
    p = [at(pts, i) for i in range(8)]
    return (
        F.when(etype == "Tt", F.abs(signed_tet_volume(*p[:4])))
        .when(etype == "Tr", triangle_area(*p[:3]))
        .when(etype == "Ln", norm(sub(p[1], p[0])))
        .when(etype == "Qd", fan_area(p[:4]))
        .when(etype == "Hx", hull_volume(p, FACES["Hx"]))
        .when(etype == "Pr", hull_volume(p[:6], FACES["Pr"]))
        .when(etype == "Py", hull_volume(p[:5], FACES["Py"]))
    )


def tet_quality(pts: Column) -> Column:
    """1 - sqrt(2) * 6V / rms edge ** 3: 0 is regular; 1 if V <= 0."""
    p = [at(pts, i) for i in range(4)]
    v = signed_tet_volume(*p)
    rms = F.sqrt(reduce(add, (dist2(a, b) for a, b in combinations(p, 2))) / 6.0)
    return F.when(v <= 0, F.lit(1.0)).otherwise(1.0 - F.sqrt(F.lit(2.0)) * 6.0 * v / (rms * rms * rms))


def tri_quality(pts: Column) -> Column:
    """1 - area / (sqrt(3) / 4 * mean edge ** 2)."""
    p = [at(pts, i) for i in range(3)]
    edge = reduce(add, (F.sqrt(dist2(a, b)) for a, b in combinations(p, 2))) / 3.0
    return 1.0 - ratio(triangle_area(*p), 0.4330127 * edge * edge)


def shape_distance(pts: Column) -> Column:
    """1 - 3 det(A) ** (2/3) / |A| ** 2 of the map from the regular tetrahedron, by edge vectors; 1 if inverted."""
    p = [at(pts, i) for i in range(4)]
    v = signed_tet_volume(*p)
    total = reduce(add, (dist2(a, b) for a, b in combinations(p, 2)))
    return F.when(v <= 0, F.lit(1.0)).otherwise(1.0 - 12.0 * F.pow(3.0 * v, F.lit(2.0 / 3.0)) / total)


def dihedral_minimum(pts: Column) -> Column:
    """Least angle between two faces of a tetrahedron, in radians."""
    p = [at(pts, i) for i in range(4)]
    n = [triangle_normal(*(p[i] for i in f)) for f in FACES["Tt"]]
    return F.least(*(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -dot(a, b)))) for a, b in combinations(n, 2)))


def circumsphere_triangle(a: Vec, b: Vec, c: Vec) -> tuple[Vec, Column]:
    u, w = sub(b, a), sub(c, a)
    n = cross(u, w)
    top = plus(scale(cross(n, u), dot(w, w)), scale(cross(w, n), dot(u, u)))
    off = scale(top, ratio(F.lit(1.0), 2.0 * dot(n, n)))
    return plus(a, off), norm(off)


def circumsphere_tet(a: Vec, b: Vec, c: Vec, d: Vec) -> tuple[Vec, Column]:
    u, v, w = sub(b, a), sub(c, a), sub(d, a)
    top = plus(plus(scale(cross(v, w), dot(u, u)), scale(cross(w, u), dot(v, v))), scale(cross(u, v), dot(w, w)))
    off = scale(top, ratio(F.lit(1.0), 2.0 * dot(u, cross(v, w))))
    return plus(a, off), norm(off)


def angle_between(a: Vec, b: Vec) -> Column:
    """Angle by the stable half-tangent form."""
    na, nb = norm(a), norm(b)
    p, q = scale(a, nb), scale(b, na)
    return 2.0 * F.atan2(norm(sub(p, q)), norm(plus(p, q)))


def barycentric_tet(p: Vec, a: Vec, b: Vec, c: Vec, d: Vec) -> tuple[Column, ...]:
    whole = signed_tet_volume(a, b, c, d)
    return tuple(ratio(v, whole) for v in (signed_tet_volume(p, b, c, d), signed_tet_volume(a, p, c, d), signed_tet_volume(a, b, p, d), signed_tet_volume(a, b, c, p)))


def barycentric_triangle(p: Vec, a: Vec, b: Vec, c: Vec) -> tuple[Column, ...]:
    u, v, w = sub(b, a), sub(c, a), sub(p, a)
    d00, d01, d11, d20, d21 = dot(u, u), dot(u, v), dot(v, v), dot(w, u), dot(w, v)
    low = d00 * d11 - d01 * d01
    s, t = ratio(d11 * d20 - d01 * d21, low), ratio(d00 * d21 - d01 * d20, low)
    return 1.0 - s - t, s, t


def rotate(v: Vec, axis: int, degrees: float) -> Vec:
    import math

    s, c = math.sin(math.radians(degrees)), math.cos(math.radians(degrees))
    i, j = (axis + 1) % 3, (axis + 2) % 3
    out = list(v)
    out[i], out[j] = v[i] * c - v[j] * s, v[i] * s + v[j] * c
    return tuple(out)


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body uses it; keeps long formulas small in the plan."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a, b)


def cylindrical(v: Vec) -> Vec:
    """(radius, angle, height)."""
    return F.sqrt(v[0] * v[0] + v[1] * v[1]), F.atan2(v[1], v[0]), v[2]


def cartesian(v: Vec) -> Vec:
    return v[0] * F.cos(v[1]), v[0] * F.sin(v[1]), v[2]


def plane_side(p: Vec, a: Vec, b: Vec, c: Vec) -> Column:
    """Signed volume of p over the plane through a, b, c."""
    return dot(cross(sub(b, a), sub(c, a)), sub(p, a))


def gradient_tet(pts: Column, f: Column) -> Vec:
    """Gradient of the linear function with values f[0..3] at the corners."""
    a, b, c, d = (at(pts, i) for i in range(4))
    u, v, w = sub(b, a), sub(c, a), sub(d, a)
    whole = dot(u, cross(v, w))
    parts = plus(plus(scale(cross(v, w), f[1] - f[0]), scale(cross(w, u), f[2] - f[0])), scale(cross(u, v), f[3] - f[0]))
    return tuple(ratio(p, whole) for p in parts)
