"""The data model: a mesh is two tables, everything else is derived.

``nodes``    (nid BIGINT, x, y, z DOUBLE)
``elements`` (eid BIGINT, etype STRING, con ARRAY<BIGINT>, tag BIGINT, fib ARRAY<DOUBLE>)

Ids are explicit columns; nothing relies on the order of rows. ``fib`` holds 0, 3 or 6 numbers. Attributes are tables
(idx, value), time series (t, idx, value), mappings (sub_idx, mesh_idx), where -1 means unmapped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trellis.session import cut

# fixed values: number of nodes of each element type
NODE_COUNT = {"Tt": 4, "Hx": 8, "Py": 5, "Pr": 6, "Qd": 4, "Tr": 3, "Ln": 2}
# fixed values: local node numbers of the faces of each volume element, in the native order
FACES = {
    "Tt": [(1, 2, 0), (0, 3, 1), (1, 3, 2), (0, 2, 3)],
    "Py": [(0, 4, 1), (1, 4, 2), (2, 4, 3), (3, 4, 0), (0, 1, 2, 3)],
    "Pr": [(0, 1, 2), (3, 4, 5), (0, 3, 5, 1), (2, 1, 5, 4), (0, 2, 4, 3)],
    "Hx": [(0, 1, 2, 3), (2, 1, 7, 6), (3, 2, 6, 5), (0, 3, 5, 4), (1, 0, 4, 7), (5, 6, 7, 4)],
    "Tr": [(0, 1, 2)],
    "Qd": [(0, 1, 2, 3)],
}
EDGES = {"Ln": [(0, 1)], "Tr": [(0, 1), (1, 2), (2, 0)], "Tt": [(0, 1), (1, 2), (2, 0), (0, 3), (1, 3), (2, 3)]}
BUCKETS = 1024
BLOCK_BITS = 13  # rows whose keys differ in these low bits only are looked up together


def by_type(table: dict[str, list[tuple[int, ...]]], con: Column, etype: Column) -> Column:
    """Array of the node tuples that ``table`` lists for the element's type; empty for others."""
    out = None
    for name, tuples in table.items():
        rows = F.array(*(F.array(*(F.get(con, F.lit(i)) for i in t)) for t in tuples))
        out = F.when(etype == name, rows) if out is None else out.when(etype == name, rows)
    return out.otherwise(F.array().cast("array<array<bigint>>"))


def dense_ids(df: DataFrame, column: str, name: str) -> DataFrame:
    """``df`` (distinct ids) with 0-based dense ids in ascending order of ``column``.

    Ids are cut into ``BUCKETS`` ranges; ranks are taken inside a range and shifted by the number of ids in the ranges
    before it, so no task sorts all of them. Ranges are even in value, not in count; ids are assumed to be spread like that.
    """
    limits = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    dealt = df.crossJoin(F.broadcast(limits)).withColumn("_b", F.floor((F.col(column) - F.col("_lo")) * F.lit(float(BUCKETS)) / (F.col("_hi") - F.col("_lo") + 1))).drop("_lo", "_hi")
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    shift = dealt.groupBy("_b").agg(F.count("*").alias("_n")).select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))  # at most BUCKETS rows
    rank = F.row_number().over(Window.partitionBy("_b").orderBy(column))
    return dealt.withColumn("_r", rank).join(F.broadcast(shift), "_b").withColumn(name, (F.col("_r") - 1 + F.col("_shift")).cast("long")).drop("_b", "_r", "_shift")


def running(df: DataFrame, by: list[str], amount: str, name: str) -> DataFrame:
    """``df`` with the running sum of ``amount`` (long, not negative) in the order of ``by``, the row's own included.

    Rows are summed up in ranges of even numbers and shifted by the ranges before, so no task takes all of them."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            if batch.num_rows:
                sums = np.cumsum(batch[amount].to_numpy()) + total
                total = int(sums[-1])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums), pa.array(np.full(len(sums), place))], names=[*batch.schema.names, "_sum", "_range"])

    schema = ", ".join([*(f"`{c}` {k}" for c, k in df.dtypes), "_sum long, _range long"])
    dealt = cut(df.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(add, schema))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = dealt.groupBy("_range").agg(F.max("_sum").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))  # one row for each range
    return dealt.join(F.broadcast(shift), "_range").withColumn(name, F.col("_sum") + F.col("_shift")).drop("_range", "_sum", "_shift")


@dataclass(frozen=True)
class Mesh:
    """``spots``: the elements with ``pts``, where the maker of the mesh has them; the same as looking them up."""

    nodes: DataFrame
    elements: DataFrame
    spots: DataFrame | None = None

    def with_elements(self, elements: DataFrame) -> Mesh:
        return replace(self, elements=elements, spots=None)

    @property
    def e2n(self) -> DataFrame:
        """(eid, pos, nid)."""
        return self.elements.select("eid", F.posexplode("con").alias("pos", "nid"))

    @property
    def n2n(self) -> DataFrame:
        """(nid, nbr): nodes that share an element, each node with itself included."""
        other = F.explode("con")
        return self.elements.select("con", F.explode("con").alias("nid")).select("nid", other.alias("nbr")).distinct()

    @property
    def pairs(self) -> DataFrame:
        """(v1, v2), v1 < v2: node pairs that share an element."""
        return self.n2n.filter("nid < nbr").select(F.col("nid").alias("v1"), F.col("nbr").alias("v2"))

    @property
    def element_edges(self) -> DataFrame:
        """(eid, pos, v1, v2): true edges of lines, triangles and tetrahedra, v1 < v2."""
        rows = self.elements.select("eid", F.posexplode(by_type(EDGES, F.col("con"), F.col("etype"))).alias("pos", "edge"))
        return rows.select("eid", "pos", F.array_min("edge").alias("v1"), F.array_max("edge").alias("v2"))

    @property
    def faces(self) -> DataFrame:
        """(eid, fpos, face, fkey): oriented faces and their sorted key."""
        rows = self.elements.select("eid", F.posexplode(by_type(FACES, F.col("con"), F.col("etype"))).alias("fpos", "face"))
        return rows.withColumn("fkey", F.array_sort("face"))

    @property
    def points(self) -> DataFrame:
        """The elements with ``pts``, the coordinates of their nodes in order."""
        return with_points(self.elements, "con", "eid", self.nodes) if self.spots is None else self.spots


def gather(df: DataFrame, ids: str, key: str, table: DataFrame, name: str, whole: bool = True) -> DataFrame:
    """``df`` with the array ``name``: for each id in the array ``ids`` what ``table`` (id, then one or more columns) holds for it.

    Rows are dealt to blocks by their ``key`` and each block is sent a row of the table once, however many of its rows ask for it; ids that are near each
    other in key order, as those of a mesh are, cost little more than the table. ``whole`` drops rows with an id that is not there (or there more than once), or without ids;
    otherwise these get nulls. Rows without a key go."""
    first, *values = table.columns
    place = F.shiftright(F.col(key), BLOCK_BITS).alias("_block")
    need = df.filter(F.col(key).isNotNull()).select(place, F.explode(ids).alias("_id")).distinct()
    sent = need.join(table.select(F.col(first).alias("_id"), F.struct(*values).alias("_v")), "_id").select("_block", F.lit(0).alias("_kind"), "_id", "_v")
    rows = df.filter(F.col(key).isNotNull()).select("*", place, F.lit(1).alias("_kind"))
    columns, single = df.columns, len(values) == 1

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # table rows of the blocks that are not over, in order
        for batch in batches:
            kind = batch["_kind"].to_numpy()
            new = pa.table({c: batch[c] for c in ("_block", "_id", "_v")}).filter(pa.array(kind == 0))
            held = new if held is None else pa.concat_tables([held, new])
            asked = batch.filter(pa.array(kind == 1))
            if asked.num_rows:
                held = held.combine_chunks()
                known_block, known = held["_block"].to_numpy(), held["_id"].to_numpy()
                lists, block = asked[ids], asked["_block"].to_numpy()
                size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
                flat = lists.flatten()
                there = flat.is_valid().to_numpy(zero_copy_only=False)
                flat = flat.fill_null(0).to_numpy()
                blocks = np.unique(known_block)
                at = np.searchsorted(blocks, np.repeat(block, size))
                dense, number = np.unique(np.concatenate((known, flat)), return_inverse=True)
                codes = np.searchsorted(blocks, known_block) * len(dense) + number[: len(known)]
                want = at * len(dense) + number[len(known) :]
                low, high = np.searchsorted(codes, want), np.searchsorted(codes, want, "right")
                there = there & (high - low == 1)
                found = held["_v"].chunk(0) if held["_v"].num_chunks else pa.array([], held["_v"].type)
                found = [found.field(i).take(pa.array(low, mask=~there)) for i in range(len(values))]
                out = found[0] if single else pa.StructArray.from_arrays(found, values)
                offsets = np.concatenate(([0], np.cumsum(size)))
                out = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), out)
                result = pa.RecordBatch.from_arrays([*(asked[c] for c in columns), out], names=[*columns, name])
                if whole:
                    missing = np.concatenate(([0], np.cumsum(~there)))
                    result = result.filter(pa.array((size > 0) & (missing[offsets[1:]] == missing[offsets[:-1]])))
                if result.num_rows:
                    yield result
            held = held.filter(pc.equal(held["_block"], batch["_block"][-1]))

    both = rows.unionByName(sent, allowMissingColumns=True).repartition("_block").sortWithinPartitions("_block", "_kind", "_id")
    kinds = dict(table.dtypes)
    item = kinds[values[0]] if single else f"struct<{','.join(f'{v}:{kinds[v]}' for v in values)}>"
    return both.mapInArrow(look_up, ", ".join([*(f"`{c}` {k}" for c, k in df.dtypes), f"`{name}` array<{item}>"]))


def with_points(df: DataFrame, con: str, key: str, nodes: DataFrame, name: str = "pts") -> DataFrame:
    """``df`` with the array of coordinates of the nodes that ``con`` lists; rows with a node that is not there are dropped."""
    return gather(df, con, key, nodes.select("nid", "x", "y", "z"), name)


def remap(df: DataFrame, con: str, key: str, mapping: DataFrame, old: str, new: str) -> DataFrame:
    """``df`` with the ids in ``con`` replaced by ``mapping`` (old, new); rows with an unmapped id are dropped."""
    return gather(df, con, key, mapping.select(old, new), "_con").withColumn(con, F.col("_con")).drop("_con")
