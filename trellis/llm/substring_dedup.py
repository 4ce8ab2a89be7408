"""Substring dedup over words, by a compacted De Bruijn graph.

Every run of ``k`` words (token k-mer) is an edge between two nodes of k - 1 words. Edges are bucketed by minimiser
(``repeats.py``): a run of edges in a text that share one is a segment, and only segments whose minimiser two documents share
are kept. Where a minimiser has one content, its segment is an edge path without a branch inside; where it has several, they
are taken apart into single edges. Segments that a document with a smaller id has too make the edge table: source
coordinates (the text of least id that holds it, and the first word), length, and the hashes of both end nodes.

The node table counts edges in and out of each node. Two segments that follow each other in their source are joined to one
path if the node between them has one edge in and one out; joins with the node table say so, and paths are the
islands between the other nodes, cut to at most ``LENGTH`` edges so that no path's text is long.

Source coordinates then verify every span: occurrences of segments in a row of one path make a span of a document, and its
words are compared with the path's words at its source. Only spans whose words agree are removed, so that a collision of
hashes removes nothing.

Defined results: null or empty text and texts of fewer than ``k`` words lose nothing; a repeat inside one document
or in rows of equal id is kept; rows of null id lose nothing and take nothing from others; rows of equal id are judged each by its own
text; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trellis.llm import kernels as K
from trellis.llm import repeats
from trellis.llm.common import materialise, release

WINDOW, GRAM, LENGTH = 50, 25, 512
SCHEMA = "doc_id long, n_words long, n_removed long, kept string"
IDS = ("key", "doc_id")
PATH = ("source", "layer", "head")


def end_nodes(docs: DataFrame, segments: DataFrame, k: int, scratch: list[DataFrame]) -> DataFrame:
    """(key, layer, pos, n, left, right): the edge table, the segments (key, layer, pos, n) with the hashes of the k - 1 words at their ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, lists = batch.column("key").to_numpy(), batch.column("segments")
            ends, flat = np.asarray(lists.offsets), lists.values
            layer, pos, n = (np.asarray(flat.field(x)) for x in ("layer", "pos", "n"))
            for lo, hi, data, offsets in K.text_chunks(batch.column("text")):
                roll, before = repeats.elements("word", data, offsets)
                own = slice(ends[lo], ends[hi])
                row = np.repeat(np.arange(hi - lo), np.diff(ends[lo : hi + 1]))
                at = before[row] + pos[own]
                nodes = [K.signed(roll.slices(x, x + k - 1)) for x in (at, at + n[own])]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key[lo:hi][row], layer[own], pos[own], n[own], *nodes)], names=["key", "layer", "pos", "n", "left", "right"])

    return repeats.with_lists(docs, segments, "segments", ("layer", "pos", "n"), scratch).select("key", "text", "segments").mapInArrow(run, "key long, layer int, pos int, n int, left long, right long")


def compact(edges: DataFrame) -> DataFrame:
    """(source, layer, pos, n, head): each segment with the first word of its unbranched path. Segments of a layer don't overlap in their source."""
    ends = edges.select(F.col("left").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(edges.select(F.col("right").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    plain = materialise(ends.groupBy("node").agg(F.sum("out").alias("out"), F.sum("into").alias("into")).filter("out = 1 and into = 1").select(F.col("node").alias("left"), F.lit(True).alias("plain")), "nodes")
    order = Window.partitionBy("key", "layer").orderBy("pos")  # the segments of one text
    goes_on = F.coalesce(F.col("plain") & (F.lag(F.col("pos") + F.col("n")).over(order) == F.col("pos")), F.lit(False))
    island = F.last(F.when(~goes_on, F.col("pos")), ignorenulls=True).over(order)
    paths = edges.join(plain, "left", "left").withColumn("island", island).withColumn("cut", F.floor((F.col("pos") - F.col("island")) / LENGTH))
    paths = paths.withColumn("head", F.min("pos").over(Window.partitionBy("key", "layer", "island", "cut")))
    out = materialise(paths.select(F.col("key").alias("source"), "layer", "pos", "n", "head"), "paths")
    release(plain)
    return out


def joined_words(docs: DataFrame, rows: DataFrame, k: int, scratch: list[DataFrame]) -> DataFrame:
    """Spans (key, start, n, source, layer, head, off, words) of the documents: runs of ``rows`` (key, start, n, source, layer, head, off) that
    follow each other both in the document and in one path, with the words they cover."""
    names = ("start", "n", *PATH, "off")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for key, text, spans in zip(batch.column("key").to_pylist(), batch.column("text"), batch.column("spans")):
                words = (text.as_py() or "").encode().split()
                flat = spans.values
                start, n, source, layer, head, off = (np.asarray(flat.field(x)).astype(np.int64) for x in names)
                order = np.lexsort((n, start, start - off, head, layer, source))
                start, n, source, layer, head, off = (x[order] for x in (start, n, source, layer, head, off))
                reach = start + n
                same = np.ones(len(start), dtype=bool)
                for x in (source, layer, head, start - off):
                    same[1:] &= x[1:] == x[:-1]
                new = ~same
                new[1:] |= start[1:] > reach[:-1]  # segments of a layer are disjoint; the same one may be listed twice
                new[:1] = True
                first = np.flatnonzero(new)
                last = np.maximum.reduceat(reach, first)
                for i, end in zip(first.tolist(), last.tolist()):
                    row = key, start[i], end - start[i], source[i], layer[i], head[i], off[i], b" ".join(words[start[i] : end + k - 1])
                    for column, value in zip(out, row):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], names=["key", *names, "words"])

    found = repeats.with_lists(docs, rows, "spans", names, scratch).select("key", "text", "spans")
    return found.mapInArrow(run, "key long, start int, n int, source long, layer int, head int, off int, words binary")


def agreeing(pairs: DataFrame, k: int) -> DataFrame:
    """(key, start, n) of the spans (key, start, n, off, words) whose words are those of their path (path_words) from edge ``off`` on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: tuple[bytes, list[bytes]] = b"", []
            keep = []
            for words, path, off, n in zip(*(batch.column(c).to_pylist() for c in ("words", "path_words", "off", "n"))):
                if path != known[0]:
                    known = path, path.split()
                keep.append(b" ".join(known[1][off : off + n + k - 1]) == words)
            yield batch.select(["key", "start", "n"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("key", "start", "n", "off", "words", "path_words").mapInArrow(run, "key long, start int, n int")


def repeated_spans(docs: DataFrame, k: int, gram: int) -> DataFrame:
    """(key, start, n): verified runs of n edges that a document with a smaller id has too, for the documents of ``repeats.keyed``."""
    docs, scratch = docs.filter("doc_id is not null"), []
    found = repeats.paths(docs, "word", k, gram, IDS)
    shared = materialise(found.groupBy("gram").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("gram"), "grams")
    found = materialise(found.join(shared, "gram", "left_semi"), "segments")
    rep = F.min(F.struct("doc_id", "key", "start")).alias("rep")
    contents = materialise(found.groupBy("gram", "content", "n").agg(rep, F.max("doc_id").alias("hi")), "contents")

    # written first: the join then deals both sides itself and can split a minimiser that a common passage gives many segments
    branching = materialise(contents.groupBy("gram").agg(F.count("*").alias("m")).filter("m > 1").select("gram"), "branching")
    todo = contents.join(branching, "gram", "left_semi").select("rep.key", "rep.start", "n", "gram", F.lit(1).cast("long").alias("weight"))
    single = materialise(repeats.edges(docs, todo, "word", k, IDS, scratch).drop("weight"), "edges")
    first = F.min(F.struct("doc_id", "key", "pos")).alias("rep")
    known = materialise(single.groupBy("gram", "edge").agg(first, F.max("doc_id").alias("hi")).filter("rep.doc_id < hi").select("gram", "edge", F.col("rep.doc_id").alias("first"), F.col("rep.key").alias("source"), F.col("rep.pos").alias("pos")), "known")
    whole = contents.filter("rep.doc_id < hi").select("gram", "content", "n", F.col("rep.doc_id").alias("first"), F.col("rep.key").alias("source"), F.col("rep.start").alias("pos"))

    segments = whole.select(F.col("source").alias("key"), F.lit(0).alias("layer"), "pos", "n").unionByName(known.select(F.col("source").alias("key"), F.lit(1).alias("layer"), "pos", F.lit(1).alias("n")))
    graph = materialise(end_nodes(docs, segments, k, scratch).distinct(), "graph")
    paths = compact(graph)
    place = lambda layer: paths.filter(F.col("layer") == layer).select("source", "layer", "pos", "head")
    whole = found.join(whole, ["gram", "content", "n"]).filter("doc_id > first").join(place(0), ["source", "pos"])
    # a segment may occur again in its representative's own document: its edges go there too
    part = single.join(known.withColumnRenamed("pos", "at"), ["gram", "edge"]).filter("doc_id > first").select("doc_id", "gram", "content", "n", "offset", "source", "at")
    part = part.join(found, ["doc_id", "gram", "content", "n"]).select("key", (F.col("start") + F.col("offset")).alias("start"), F.lit(1).alias("n"), "source", F.col("at").alias("pos")).join(place(1), ["source", "pos"])
    rows = [x.select("key", "start", "n", *PATH, (F.col("pos") - F.col("head")).alias("off")) for x in (whole, part)]
    spans = materialise(joined_words(docs, rows[0].unionByName(rows[1]), k, scratch), "spans")

    heads = paths.groupBy(*PATH).agg(F.max(F.col("pos") + F.col("n")).alias("stop"))
    own = heads.select(F.col("source").alias("key"), F.col("head").alias("start"), (F.col("stop") - F.col("head")).alias("n"), *PATH, F.lit(0).alias("off"))
    sources = materialise(joined_words(docs, own, k, scratch).select(*PATH, F.col("words").alias("path_words")).distinct(), "sources")
    runs = materialise(agreeing(spans.join(sources, list(PATH)), k), "runs")
    release(shared, found, contents, branching, single, known, graph, paths, spans, sources, *scratch)
    return runs


def dedup_words(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): each text without the words of windows that a smaller doc_id also has."""
    docs = repeats.keyed(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, lists = batch.columns
            total, removed, kept = [], [], []
            for text, runs in zip(texts, lists):
                words = (text.as_py() or "").encode().split()
                total.append(len(words))
                if runs.is_valid:
                    flat = runs.values
                    gone = repeats.covered(flat.field("start").to_numpy(), flat.field("n").to_numpy(), window, len(words))
                    words = [words[i] for i in np.flatnonzero(~gone)]
                removed.append(total[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([ids, pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return repeats.with_runs(docs, repeated_spans(docs, window, gram)).mapInArrow(run, SCHEMA)
