"""Traversal and fixed-point operators: loops of joins over a frontier, with lineage cut in the shared folder.

Only counts come to the driver. Loops end when nothing changes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trellis.functions import geometry as G
from trellis.model import Mesh, running
from trellis.operators.blocks import dealt, fixpoint
from trellis.session import cut

PIECE = 1_000_000  # links that a task joins up at once
STRIP = 4_000_000  # links between layers that a task orders at once, about

def reach(links: DataFrame, seeds: DataFrame, rounds: int | None = None, blocked: DataFrame | None = None) -> DataFrame:
    """(node, depth) of all nodes reachable from ``seeds`` (node) over directed ``links`` (a, b). Blocked nodes are reached but not left."""
    links = cut(links.select("a", "b"))
    seen = cut(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    front = seen
    depth = 0
    while rounds is None or depth < rounds:
        depth += 1
        start = front if blocked is None else front.join(blocked.select("node"), "node", "left_anti")
        step = start.join(links, start.node == links.a).select(F.col("b").alias("node")).distinct()
        front = cut(step.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front))
    return seen


def nodal_links(mesh: Mesh) -> DataFrame:
    return mesh.n2n.filter("nid <> nbr").select(F.col("nid").alias("a"), F.col("nbr").alias("b"))


def reach_in_radius(mesh: Mesh, seed: int, radius: float) -> DataFrame:
    """Nodes that a walk from ``seed`` reaches without leaving the open ball of ``radius`` around it."""
    centre = mesh.nodes.filter(F.col("nid") == seed).select(*(F.col(c).alias(f"_{c}") for c in "xyz"))
    d2 = sum(((F.col(c) - F.col(f"_{c}")) ** 2 for c in "xyz"), F.lit(0.0))
    inside = mesh.nodes.crossJoin(F.broadcast(centre)).filter(d2 < radius * radius).select("nid")
    links = nodal_links(mesh).join(inside.withColumnRenamed("nid", "b"), "b", "left_semi").select("a", "b")
    return reach(links, mesh.nodes.filter(F.col("nid") == seed).select(F.col("nid").alias("node")))


def least_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links (a, b), ascending, and the least node of each one's part."""
    ids, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b = at.reshape(2, -1)
    label = np.arange(len(ids))
    while len(a):
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], least)
        np.minimum.at(label, label[b], least)
        while (label[label] != label).any():
            label = label[label]
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return ids, ids[label]


def join_up(piece: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A kernel that gives (node, least node of its part) for every ``piece`` links (a, b)."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in chain(batches, (None,)):
            if batch is not None:
                held.append((batch["a"].to_numpy(), batch["b"].to_numpy()))
                n += batch.num_rows
            if held and (batch is None or n >= piece):
                ids, label = least_labels(*(np.concatenate(part) for part in zip(*held)))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(label)], names=["node", "component"])
                held, n = [], 0

    return kernel


def spread(links: DataFrame) -> DataFrame:
    """(node, component): the component is its least node. Few links join up in one task; else least labels spread over links, then jump along themselves."""
    if links.limit(PIECE + 1).count() <= PIECE:
        return cut(links.select("a", "b").repartition(1).mapInArrow(join_up(PIECE), "node long, component long"))
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = cut(both.filter("a <> b"))
    every = both.select(F.col("a").alias("node"))
    label = cut(every.distinct().withColumn("component", F.col("node")))
    while True:
        near = both.join(label, both.b == label.node).groupBy("a").agg(F.min("component").alias("m"))
        new = label.join(near, label.node == near.a, "left").select("node", F.least("component", F.coalesce("m", "component")).alias("component"), F.col("component").alias("old"))
        jump = new.select(F.col("node").alias("component"), F.col("component").alias("next"))
        new = cut(new.join(jump, "component").select("node", F.col("next").alias("component"), "old"))
        if new.filter("component <> old").isEmpty():
            return new.select("node", "component")
        label = new.select("node", "component")


def components(links: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, component): the component is its least node.

    Links (a, b), dealt by ranges of ``place`` (without one: the lesser node), join up in bounded pieces first; only the pieces' parts that share a
    node are linked across all."""
    place = F.col("place") if "place" in links.columns else F.least("a", "b")
    stars = links.select("a", "b", place.alias("place")).repartitionByRange("place").select("a", "b").mapInArrow(join_up(PIECE), "node long, component long").withColumnRenamed("component", "root")
    stars = cut(stars.groupBy("node").agg(F.array_sort(F.collect_set("root")).alias("roots")))
    across = cut(stars.filter(F.size("roots") > 1).select(F.get("roots", F.lit(0)).alias("a"), F.explode("roots").alias("b")).filter("a <> b").distinct())
    label = spread(across).withColumnRenamed("node", "root")
    found = stars.select("node", F.get("roots", F.lit(0)).alias("root")).join(label, "root", "left").select("node", F.coalesce("component", "root").alias("component"))
    return found if nodes is None else nodes.select("node").distinct().join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def numbered(parts: DataFrame) -> DataFrame:
    """(node, part): components numbered from 0 by their least node."""
    order = parts.select("component").distinct().withColumn("part", F.row_number().over(Window.orderBy("component")) - 1)  # one row for each part
    return parts.join(order, "component").select("node", F.col("part").cast("long").alias("part"))


def unreachable(mesh: Mesh) -> DataFrame:
    """(eid, part): connected parts of the elements, over shared nodes, numbered by their least node."""
    star = mesh.elements.select(F.get("con", F.lit(0)).alias("a"), F.explode("con").alias("b"))
    parts = numbered(components(star, mesh.e2n.select(F.col("nid").alias("node"))))
    return mesh.elements.select("eid", F.get("con", F.lit(0)).alias("node")).join(parts, "node").select("eid", "part")


def grow_layers(mesh: Mesh, nodes: DataFrame, layers: int) -> DataFrame:
    """(eid) of ``layers`` rounds nodes -> elements -> nodes."""
    from trellis.operators.select import elements_of_nodes, nodes_of_elements

    eids = elements_of_nodes(mesh, nodes)
    for _ in range(layers - 1):
        eids = elements_of_nodes(mesh, nodes_of_elements(mesh, eids))
    return eids


def local_pairs(static: dict) -> tuple[np.ndarray, np.ndarray]:
    """Local numbers (a, b) of all ordered node pairs that share a cell, once each."""
    n = len(static["ids"])
    codes = [np.minimum(c[:, i], c[:, j]).astype(np.int64) * n + np.maximum(c[:, i], c[:, j]) for k, c in static["con"].items() for i in range(k) for j in range(i)]
    codes = np.sort(np.concatenate(codes)) if codes else np.zeros(0, dtype=np.int64)
    codes = codes[np.diff(codes, prepend=-1) > 0]  # several times faster than unique()
    a, b = codes // n, codes % n
    a, b = a[a != b], b[a != b]
    return np.concatenate((a, b)), np.concatenate((b, a))


def relax(static: dict, x: np.ndarray, fresh: np.ndarray, length: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Own nodes' values lowered to the least sum of a neighbour's value and ``length(a, b)``, from ``fresh`` nodes on until nothing changes."""
    value = x[:, 0]
    front = fresh & np.isfinite(value)
    if not front.any():
        return x
    a, b = local_pairs(static)
    a, b = a[static["own"][b]], b[static["own"][b]]
    w = length(a, b)
    while front.any():
        some = front[a]
        new = value.copy()
        np.minimum.at(new, b[some], value[a[some]] + w[some])
        front, value = new < value, new
    return value[:, None]


def graph_distance(mesh: Mesh, start: DataFrame) -> DataFrame:
    """(nid, value): length of the shortest path along node pairs that share an element, from nodes in ``start`` (nid); unreached nodes are left out.

    Blocks relax their own pairs to the end: the least sum is the same in any order."""
    begin = start.select("nid", F.lit(0.0).alias("value")).distinct()
    nodes = dealt(mesh.nodes.join(begin, "nid", "left").select("nid", *"xyz", F.coalesce("value", F.lit(float("inf"))).alias("value")))

    def solve(static: dict, x: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        def length(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            d = static["p"][b] - static["p"][a]
            return np.sqrt(d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2])

        return relax(static, x, fresh, length)

    return fixpoint(mesh.elements.select("eid", "con"), nodes, list("xyz"), ["value"], solve).filter(F.col("value") < float("inf"))


def arrivals(x: np.ndarray, p: np.ndarray, t: np.ndarray) -> np.ndarray:
    """First arrival at points x of a front of unit speed with times t at p (rows of one, two or three points): the least over the
    points, the insides of the edges between them, and the inside of their triangle."""
    n = p.shape[1]
    with np.errstate(all="ignore"):
        best = (t + np.linalg.norm(x[:, None] - p, axis=2)).min(axis=1)
        for i, j in ((0, 1), (1, 2), (0, 2)):
            if j >= n:
                continue
            a, e, s, d = p[:, i], p[:, j] - p[:, i], t[:, j] - t[:, i], x - p[:, i]
            length2, along = (e * e).sum(1), (d * e).sum(1)
            slope2 = s * s / length2
            high = np.sqrt(np.maximum((d * d).sum(1) - along**2 / length2, 0) / (1 - slope2))
            at = (along - s * high) / length2
            value = t[:, i] + at * s + np.linalg.norm(x - a - at[:, None] * e, axis=1)
            best = np.where((slope2 < 1) & (at > 0) & (at < 1), np.fmin(best, value), best)
        if n == 3:
            u, v, d = p[:, 1] - p[:, 0], p[:, 2] - p[:, 0], x - p[:, 0]
            q, r = t[:, 1] - t[:, 0], t[:, 2] - t[:, 0]
            uu, uv, vv, du, dv = ((a * b).sum(1) for a, b in ((u, u), (u, v), (v, v), (d, u), (d, v)))
            det = uu * vv - uv * uv
            ga, gb = (vv * q - uv * r) / det, (uu * r - uv * q) / det  # slowness in the plane is ga u + gb v
            plane2 = ga * q + gb * r
            normal = np.cross(u, v)
            high, up = np.abs((d * normal).sum(1)) / np.linalg.norm(normal, axis=1), np.sqrt(1 - plane2)
            fa, fb = (vv * du - uv * dv) / det, (uu * dv - uv * du) / det  # foot of x in the plane
            la, lb = fa - ga * high / up, fb - gb * high / up
            value = t[:, 0] + fa * q + fb * r + high * up
            best = np.where((plane2 < 1) & (la > 0) & (lb > 0) & (la + lb < 1), np.fmin(best, value), best)
    return best


def eikonal(mesh: Mesh, start: DataFrame) -> DataFrame:
    """(nid, value): first arrival of a front of unit speed from ``start`` (nid), 0 there.

    A node's value is the least over its lines, triangles and tetrahedra of the arrivals through their opposite points, edges and faces. Blocks solve
    elements around nodes that changed anew, all from the last pass's values, until no value falls by more than a millionth. Unreached nodes keep 1e100."""
    far = 1e100
    nodes = dealt(mesh.nodes.join(start.select("nid", F.lit(0.0).alias("value")).distinct(), "nid", "left").select("nid", *"xyz", F.coalesce("value", F.lit(far)).alias("value")))

    def solve(static: dict, x: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        t, p, own = x[:, 0], static["p"], static["own"]
        waiting = fresh & (t < far)
        if not waiting.any():
            return x
        sides = [np.linalg.norm(p[c[:, 1]] - p[c[:, 0]], axis=1) for n, c in static["con"].items() if n in (2, 3, 4)]
        ahead = float(np.median(np.concatenate(sides))) if sides else 0.0
        while waiting.any():
            front = waiting & (t <= t[waiting].min() + ahead)  # later nodes wait until the earlier ones are settled
            waiting &= ~front
            new = t.copy()
            for size in (n for n in (2, 3, 4) if n in static["con"]):
                con = static["con"][size]
                con = con[front[con].any(axis=1)]
                times = t[con]
                for k in range(size):
                    rest = [i for i in range(size) if i != k]
                    some = own[con[:, k]] & (times[:, rest].min(axis=1) < times[:, k])  # a front comes from earlier nodes
                    if some.any():
                        c = con[some]
                        np.minimum.at(new, c[:, k], arrivals(p[c[:, k]], p[c[:, rest]], times[some][:, rest]))
            better = t - new > 1e-6 * (1 + new)
            t = np.where(better, new, t)
            waiting |= better
        return t[:, None]

    return fixpoint(mesh.elements.select("eid", "con"), nodes, list("xyz"), ["value"], solve)


def distance_field(mesh: Mesh, start: DataFrame, end: DataFrame | None = None) -> DataFrame:
    """Arrival from ``start``; with ``end`` the relative distance s / (s + e), 0 where s + e <= 1e-6."""
    s = eikonal(mesh, start)
    if end is None:
        return s
    e = eikonal(mesh, end).withColumnRenamed("value", "e")
    total = F.col("value") + F.col("e")
    return s.join(e, "nid").select("nid", F.when(total > 1e-6, F.col("value") / total).otherwise(0.0).alias("value"))


def descend(mesh: Mesh, data: DataFrame) -> DataFrame:
    """(nid, minimum): the node where a walk to the least neighbour (ties: least id) ends, by pointer jumping."""
    near = mesh.n2n.join(data.select(F.col("idx").alias("nbr"), "value"), "nbr").groupBy("nid").agg(F.min(F.struct("value", "nbr")).alias("m"))
    step = cut(near.select("nid", F.col("m.nbr").alias("minimum")))
    while True:
        jump = step.select(F.col("nid").alias("minimum"), F.col("minimum").alias("next"))
        new = cut(step.join(jump, "minimum").select("nid", "next", "minimum").toDF("nid", "minimum", "old"))
        if new.filter("minimum <> old").isEmpty():
            return new.select("nid", "minimum")
        step = new.select("nid", "minimum")


def transport(mesh: Mesh, seeds: DataFrame, gradient: DataFrame, least_dot: float = 0.99, far: float | None = None) -> DataFrame:
    """(nid, source, value): data of ``seeds`` (nid, value) carried along a nodal ``gradient`` (idx, value array) field.

    In each round an unreached node takes the value of the neighbour reached in the round before whose direction to it has the largest dot (above
    ``least_dot``; ties: least id) with the gradient there; paths longer than ``far`` end. Blocks replay all rounds with the rounds at which the others'
    nodes were reached; what happens by a round depends on earlier ones only, so the blocks end at the one common history."""
    g = gradient.select(F.col("idx").alias("nid"), *(F.get("value", F.lit(i)).alias(f"g{c}") for i, c in enumerate("xyz")))
    begin = seeds.select("nid", F.lit(0.0).alias("round"), F.col("nid").cast("double").alias("source"), "value", F.lit(0.0).alias("len"))
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    every = mesh.nodes.join(g, "nid", "left").join(begin, "nid", "left")
    nodes = dealt(every.select("nid", *"xyz", *(F.coalesce(f"g{c}", nan).alias(f"g{c}") for c in "xyz"), F.coalesce("round", inf).alias("round"), *(F.coalesce(c, nan).alias(c) for c in ("source", "value", "len"))))

    def solve(static: dict, x: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        if not np.isfinite(x[:, 0]).any():
            return x
        p, own = static["p"], static["own"]
        a, b = local_pairs(static)
        d, g = p[b, :3] - p[a, :3], p[a, 3:]
        dots = lambda u, v: u[:, 0] * v[:, 0] + u[:, 1] * v[:, 1] + u[:, 2] * v[:, 2]
        with np.errstate(all="ignore"):
            length = np.sqrt(dots(d, d))
            dot = dots(d, g) / (length * np.sqrt(dots(g, g)))
        some = (dot > least_dot) & own[b] & np.isfinite(dot)
        a, b, length, dot = a[some], b[some], length[some], dot[some]
        x[own & (x[:, 0] > 0)] = (np.inf, np.nan, np.nan, np.nan)
        reached = np.unique(x[np.isfinite(x[:, 0]), 0])
        n = 0.0
        while n is not None:
            on = (x[a, 0] == n) & (x[b, 0] > n + 1)
            if far is not None:
                on &= x[a, 3] + length <= far
            if on.any():
                i, j, s, t = a[on], b[on], dot[on], length[on]
                order = np.lexsort((i, -s, j))
                i, j, t = i[order], j[order], t[order]
                top = np.concatenate(([True], j[1:] != j[:-1]))
                i, j, t = i[top], j[top], t[top]
                x[j] = np.stack((np.full(len(j), n + 1), x[i, 1], x[i, 2], x[i, 3] + t), 1)
                n += 1
            else:
                later = reached[reached > n]
                n = later[0] if len(later) else None
        return x

    found = fixpoint(mesh.elements.select("eid", "con"), nodes, [*"xyz", "gx", "gy", "gz"], ["round", "source", "value", "len"], solve)
    found = found.filter(F.col("round") < float("inf")).select("nid", F.col("source").cast("long").alias("source"), "value")
    return seeds.select("nid", F.col("nid").alias("source"), "value").unionByName(found.join(seeds.select("nid"), "nid", "left_anti"))


def partition(mesh: Mesh, levels: int) -> DataFrame:
    """(eid, part): 2 ** levels parts of nearly equal numbers of elements, by halving along x, y and z in turn at approximate medians."""
    parts = mesh.points.select("eid", G.barycenter(F.col("pts")).alias("p"), F.lit(0).cast("long").alias("part"))
    for level in range(levels):
        axis = F.col("p")["xyz"[level % 3]]
        middle = parts.groupBy("part").agg(F.percentile_approx(axis, 0.5, 10_000).alias("m"))
        parts = cut(parts.join(middle, "part").select("eid", "p", (F.col("part") * 2 + (axis > F.col("m")).cast("long")).alias("part")))
    return parts.select("eid", "part")


def parents(mesh: Mesh, nodes: DataFrame) -> DataFrame:
    """(depth, node, parents): the layer of each node but the roots, and its neighbours in the layer before. ``nodes`` (nid, x, y, z, root boolean)."""
    nodes = dealt(nodes.select("nid", *"xyz", F.when(F.col("root"), 0.0).otherwise(F.lit(float("inf"))).alias("depth")))

    def solve(static: dict, x: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        return relax(static, x, fresh, lambda a, b: np.ones(len(a)))

    def finish(static: dict, x: np.ndarray) -> pa.Table:
        depth = x[:, 0]
        a, b = local_pairs(static)
        some = static["own"][b] & np.isfinite(depth[b]) & (depth[a] + 1 == depth[b])
        a, b = a[some], b[some]
        order = np.lexsort((b, depth[b]))  # by layer, so that a reader of some layers can skip the others
        a, b = a[order], b[order]
        first = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1]))) if len(b) else b
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(b)), pa.int32()), pa.array(static["ids"][a]))
        return pa.table({"depth": pa.array(depth[b[first]].astype(np.int64)), "node": pa.array(static["ids"][b[first]]), "parents": lists})

    return fixpoint(mesh.elements.select("eid", "con"), nodes, [], ["depth"], solve, (finish, "depth long, node long, parents array<long>"))


def order_strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, part, depth, place) of consecutive layers (depth, node, parents), from the rows with a place of the layer before them."""
    held = pa.Table.from_batches(list(batches))
    if not held.num_rows:
        return
    known = held.filter(held["place"].is_valid())
    ids, place, part = (known[c].to_numpy() for c in ("node", "place", "part"))
    held = held.filter(held["place"].is_null()).select(["depth", "node", "parents"])
    held = held.take(np.argsort(held["depth"].to_numpy(), kind="stable")).combine_chunks()
    depth, node = held["depth"].to_numpy(), held["node"].to_numpy()
    lists = held["parents"].combine_chunks()
    flat, offsets = lists.flatten().to_numpy(), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
    ends = np.append(np.flatnonzero(np.diff(depth)) + 1, len(depth)) if len(depth) else []
    start = 0
    for end in ends:
        by_id = np.argsort(ids)
        at = by_id[np.searchsorted(ids, flat[offsets[start] : offsets[end]], sorter=by_id)]
        least = np.minimum.reduceat(place[at], offsets[start:end] - offsets[start])
        by_place = np.argsort(place)
        part_of = part[by_place[np.searchsorted(place, least, sorter=by_place)]]
        order = np.lexsort((node[start:end], least))
        ids, part, place = node[start:end][order], part_of[order], np.arange(1, end - start + 1)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (ids, part, depth[start:end], place)], names=["node", "part", "depth", "place"])
        start = end


def reverse_cuthill_mckee(mesh: Mesh) -> DataFrame:
    """(nid, rank): breadth-first order from the least node of each part, neighbours in order of id, then reversed.

    A node's place in its layer follows the place of its first parent, then its id, which is the order a queue would give; all parts' layers of a depth
    are ordered together. Layers and parents come from blocks. A layer needs the places of the one before, so layers are ordered one after the other,
    but a task takes as many as have ``STRIP`` links, and rounds go by links, not by layers; a layer with more is ordered by all tasks. A rank counts all nodes before it."""
    star = mesh.elements.select(F.array_compact("con").alias("con")).select(F.get("con", F.lit(0)).alias("a"), F.explode("con").alias("b"))
    every = mesh.nodes.join(components(star).withColumnRenamed("node", "nid"), "nid", "full")  # also ids that only elements list
    every = cut(every.select("nid", *"xyz", (F.col("nid") == F.coalesce("component", "nid")).alias("root")))
    steps = parents(mesh, every)
    layers = steps.groupBy("depth").agg(F.sum(F.size("parents").cast("long")).alias("links"))
    layers = running(layers, ["depth"], "links", "sum").withColumn("strip", F.floor((F.col("sum") - 1) / STRIP))
    strips = layers.groupBy("strip").agg(F.min("depth").alias("low"), F.max("depth").alias("high"), F.min_by("links", "depth").alias("links")).orderBy("strip").collect()
    spans = []
    for r in strips:  # only the first layer of a strip can be a wide one
        spans += [(r.low, r.high, False)] if r.links <= STRIP else [(r.low, r.low, True), (r.low + 1, r.high, False)]
    columns = ["node", "part", "depth", "place"]
    one = F.lit(1).cast("long").alias("one")
    roots = every.filter("root").select(F.col("nid").alias("node"), F.col("nid").alias("part"), F.lit(0).cast("long").alias("depth"), one)
    found = [cut(running(roots, ["node"], "one", "place").select(*columns))]
    for low, high, wide in spans:
        if low > high:
            continue
        new = steps.filter(F.col("depth").between(low, high))
        asked = steps.filter(F.col("depth") == low).select(F.explode("parents").alias("parent"))
        front = found[-1].filter(F.col("depth") == low - 1)
        if wide:
            links = new.select("node", F.explode("parents").alias("parent")).join(front.select(F.col("node").alias("parent"), "part", "place"), "parent")
            first = links.groupBy("node").agg(F.min(F.struct("place", "part")).alias("m"))
            first = cut(first.select("node", F.col("m.part").alias("part"), F.lit(low).cast("long").alias("depth"), F.col("m.place").alias("parent"), one))
            found.append(cut(running(first, ["parent", "node"], "one", "place").select(*columns)))
        else:
            front = front.join(asked, front.node == asked.parent, "left_semi").select("node", "part", "place")
            rows = new.unionByName(front, allowMissingColumns=True)
            found.append(cut(rows.repartition(1).mapInArrow(order_strip, "node long, part long, depth long, place long")))
    done = found[0]
    for rows in found[1:]:
        done = done.unionByName(rows)
    layers = running(done.groupBy("part", "depth").agg(F.count("*").alias("n"), F.min("place").alias("first")), ["part", "depth"], "n", "sum")
    total = done.agg(F.count("*").alias("total"))
    ranked = done.join(layers, ["part", "depth"]).crossJoin(F.broadcast(total))
    return ranked.select(F.col("node").alias("nid"), (F.col("total") - F.col("sum") + F.col("n") - 1 - (F.col("place") - F.col("first"))).alias("rank"))


def reindex(mesh: Mesh) -> Mesh:
    """The mesh with nodes in reverse Cuthill-McKee order."""
    from trellis.model import remap

    order = cut(reverse_cuthill_mckee(mesh))
    return Mesh(mesh.nodes.join(order, "nid").select(F.col("rank").alias("nid"), "x", "y", "z"), remap(mesh.elements, "con", "eid", order, "nid", "rank"))
