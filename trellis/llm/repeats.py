"""Runs of windows of k elements (words or bytes) that share a minimiser, and the byte windows that occur more than once.

Windows in a row that share a minimiser (the least hashed gram of ``gram`` elements inside the window) form a path; equal
windows have equal minimisers, so a path meets its repeats under its minimiser's key. Per key, paths of equal content collapse
first (partial aggregation, so thousands of copies cost one row for each task). Only where several different
paths share a minimiser are they branching; there the single windows of one representative of each path are
compared. Comparisons are of hashes: 64 bits of content under 64 bits of minimiser. Coordinates (row, first
element) lead from each path back to its source.

Rows are named by a key, a hash of id and text, so that null and repeated ids stay apart. Nothing is collected, and no pairs
of documents are made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.llm import kernels as K
from trellis.llm.common import materialise, parted, release

PATHS = "start int, n int, gram long, content long"
EDGES = "pos int, gram long, edge long, weight long, offset int, n int, content long"


def keyed(docs: DataFrame) -> DataFrame:
    """(key, doc_id, text): ``key`` names a row; rows of equal id and text share it, and all that is found for them."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.select(F.xxhash64("doc_id", F.col("doc_id").isNull(), "text").alias("key"), "doc_id", "text")


def schema(ids: tuple[str, ...], rest: str) -> str:
    return ", ".join((*(f"{c} long" for c in ids), rest))


def elements(unit: str, data: np.ndarray, offsets: np.ndarray) -> tuple[K.Rolling, np.ndarray]:
    """Running hashes of the chunk's elements and the number of elements before each row."""
    if unit == "byte":
        return K.Rolling(K.byte_values(data), K.BYTE_POWERS), offsets
    starts, ends, before = K.words(data, offsets)
    return K.Rolling(K.word_hashes(data, starts, ends)), before


def chunk_paths(roll: K.Rolling, before: np.ndarray, k: int, gram: int) -> tuple[np.ndarray, ...]:
    """Row, first window, windows, minimiser and content hash of every path in a chunk."""
    lengths = np.diff(before)
    windows = np.maximum(lengths - k + 1, 0)
    rows = np.flatnonzero(windows)
    if not len(rows):
        none = np.empty(0, dtype=np.int64)
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    grams = roll.windows(gram)
    mask = K.U64((1 << int(len(grams)).bit_length()) - 1)
    keys = (grams & ~mask) | np.arange(len(grams), dtype=np.uint64)
    least = (K.sliding_min(keys, k - gram + 1) & mask).astype(np.int64)
    at = K.ranges(before[rows], windows[rows])
    chosen = least[at]
    first = np.concatenate(([0], np.flatnonzero(chosen[1:] != chosen[:-1]) + 1))
    count = np.diff(np.concatenate((first, [len(chosen)])))
    start = at[first]
    return np.searchsorted(before, start, "right") - 1, start, count, grams[chosen[first]], roll.slices(start, start + count + k - 1)


def paths(docs: DataFrame, unit: str, k: int, gram: int, ids: tuple[str, ...]) -> DataFrame:
    """The paths of every text, named by its ``ids`` (long columns without nulls)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = [batch.column(c).to_numpy() for c in ids]
            for lo, hi, data, offsets in K.text_chunks(batch.column("text")):
                roll, before = elements(unit, data, offsets)
                row, start, count, grams, content = chunk_paths(roll, before, k, gram)
                # rows without text share their neighbour's offset; the last of equal offsets owns the start
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(x[lo:hi][row]) for x in named), pa.array((start - before[row]).astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(K.signed(grams)), pa.array(K.signed(content))],
                    names=[*ids, "start", "n", "gram", "content"],
                )

    return docs.select(*ids, "text").mapInArrow(run, schema(ids, PATHS))


def with_lists(docs: DataFrame, rows: DataFrame, name: str, columns: tuple[str, ...], scratch: list[DataFrame]) -> DataFrame:
    """The documents that have ``rows`` (key, columns), with a list of those. Texts of other documents are not dealt out. The lists'
    table goes to ``scratch``, for the caller to release."""
    lists = materialise(rows.groupBy("key").agg(F.collect_list(F.struct(*columns)).alias(name)), name)
    scratch.append(lists)
    return parted(docs, lists, "key", "key")[1].join(lists, "key")


def edges(docs: DataFrame, todo: DataFrame, unit: str, k: int, ids: tuple[str, ...], scratch: list[DataFrame]) -> DataFrame:
    """The single windows of the paths in ``todo`` (key, start, n, gram, weight), with offset, windows and content of their path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named, lists = [batch.column(c).to_numpy() for c in ids], batch.column("paths")
            ends, flat = np.asarray(lists.offsets), lists.values
            first, count, gram, weight = (np.asarray(flat.field(x)) for x in ("start", "n", "gram", "weight"))
            for lo, hi, data, offsets in K.text_chunks(batch.column("text")):
                roll, before = elements(unit, data, offsets)
                own = slice(ends[lo], ends[hi])
                row = np.repeat(np.arange(hi - lo), np.diff(ends[lo : hi + 1]))
                n = count[own].astype(np.int64)
                start = before[row] + first[own]
                at = K.ranges(start, n)
                content = K.signed(roll.slices(start, start + n + k - 1))
                row, start, n_of, content, gram_of, weight_of = (np.repeat(x, n) for x in (row, start, count[own], content, gram[own], weight[own]))
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(x[lo:hi][row]) for x in named), pa.array((at - before[row]).astype(np.int32)), pa.array(gram_of), pa.array(K.signed(roll.slices(at, at + k))), pa.array(weight_of), pa.array((at - start).astype(np.int32)), pa.array(n_of), pa.array(content)],
                    names=[*ids, "pos", "gram", "edge", "weight", "offset", "n", "content"],
                )

    return with_lists(docs, todo, "paths", ("start", "n", "gram", "weight"), scratch).select(*ids, "text", "paths").mapInArrow(run, schema(ids, EDGES))


def repeated(docs: DataFrame, unit: str, k: int, gram: int) -> DataFrame:
    """(key, start, n): runs of n windows, of the documents of ``keyed``, that occur anywhere else too.

    Null and short texts have no windows and no rows here."""
    ids, scratch = ("key",), []
    found = paths(docs, unit, k, gram, ids)
    shared = materialise(found.groupBy("gram").agg(F.count("*").alias("c")).filter("c > 1").select("gram"), "grams")
    found = materialise(found.join(shared, "gram", "left_semi"), "paths")
    release(shared)
    nodes = materialise(found.groupBy("gram", "content", "n").agg(F.count("*").alias("weight"), F.min(F.struct("key", "start")).alias("rep")), "contents")
    whole = materialise(found.join(nodes.filter("weight > 1").select("gram", "content", "n"), ["gram", "content", "n"], "left_semi").select("key", "start", "n"), "whole")
    release(found)

    # written first: the join then deals both sides itself and can split a minimiser that a common passage gives many paths
    branching = materialise(nodes.groupBy("gram").agg(F.count("*").alias("m")).filter("m > 1").select("gram"), "branching")
    todo = nodes.join(branching, "gram", "left_semi").select("rep.key", "rep.start", "n", "gram", "weight")
    single = materialise(edges(docs, todo, unit, k, ids, scratch).drop("offset", "n", "content"), "edges")
    release(nodes, branching, *scratch)
    known = materialise(single.groupBy("gram", "edge").agg(F.sum("weight").alias("c")).filter("c > 1").select("gram", "edge"), "known")
    part = single.filter("weight = 1").join(known, ["gram", "edge"], "left_semi")
    runs = materialise(whole.unionByName(part.select("key", F.col("pos").alias("start"), F.lit(1).alias("n"))), "runs")
    release(whole, single, known)
    return runs


def covered(starts: np.ndarray, counts: np.ndarray, k: int, length: int) -> np.ndarray:
    """Elements of one document that its removed windows cover."""
    step = np.zeros(length + 1, dtype=np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + counts + k - 1, -1)
    return np.cumsum(step[:-1]) > 0


def with_runs(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """Every document of ``keyed`` with its list of runs, null if none."""
    lists = materialise(runs.groupBy("key").agg(F.collect_list(F.struct("start", "n")).alias("runs")), "lists")
    alone, rest = parted(docs, lists, "key", "key")
    none = F.lit(None).cast(lists.schema["runs"].dataType).alias("runs")
    return alone.select("doc_id", "text", none).unionByName(rest.join(lists, "key", "left").select("doc_id", "text", "runs"))
