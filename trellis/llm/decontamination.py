"""Benchmark decontamination: size-partitioned MinHash containment search with exact verification.

Test items are partitioned by the number of their shingles (upper bounds in powers of two). For a partition with bound c the
documents are cut into windows of two adjacent blocks of c shingles, so that an item never meets a window more than
about four times its size, and its containment in the document becomes a Jaccard similarity of a fifth or more with
some window. One agreeing MinHash value of ``HASHES`` makes a (document, item) candidate: the hash's least
shingle of the item is in the document with a chance of the containment t, and is then the least of its window with a
chance of 1/5 or more, so a pair is missed with a chance of about (1 - t / 5) ** 64, 2e-5 at t = 0.8, wherever in
the document the shingles lie. Candidates are verified on the words themselves: the item's distinct shingles that the
whole document holds are counted.

The items go to the tasks in blocks of at most ``ITEM_BYTES`` of text, one pass over the documents for each block, so what
is sent has a bound whatever the benchmark's size. Documents are never shuffled.

Defined results: words are runs of bytes other than white space, A-Z lower-cased; null, empty and items of fewer than
n words match nothing; repeated items are all reported; a document is reported once for each item; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.llm import kernels as K

HASHES, ITEM_BYTES = 64, 8 << 20
LEAKS = "doc_id long, item_id long, n_shared long, n_item long"
_LOWER = bytes(K.LOWER.tolist())
_FACTORS = np.random.default_rng(77).integers(1, 2**63, 256, dtype=np.uint64) * K.U64(2) + K.U64(1)


def shingles(text: bytes, n: int) -> set[tuple[bytes, ...]]:
    words = text.translate(_LOWER).split()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def minhash(hashes: np.ndarray, j: int) -> np.ndarray:
    return ((hashes * _FACTORS[j]) >> K.U64(32)).astype(np.uint32)


class Items:
    """A block of items, by size partition and hash."""

    def __init__(self, rows: list[tuple[int, str | None]], n: int):
        self.n = n
        self.ids, self.sets, self.partitions = [], [], {}
        sizes: dict[int, list[int]] = {}
        hashed = []
        for item, text in rows:
            found = shingles((text or "").encode(), n)
            if found:
                _, _, data, offsets = next(K.text_chunks(pa.array([text])))
                hashed.append(document_shingles(data, offsets, n)[0])
                sizes.setdefault((len(found) - 1).bit_length(), []).append(len(self.ids))
                self.ids.append(item)
                self.sets.append(found)
        for size, members in sorted(sizes.items()):
            values = np.array([[minhash(hashed[i], j).min() for i in members] for j in range(HASHES)])
            order = np.argsort(values, axis=1, kind="stable")
            values = np.take_along_axis(values, order, 1)
            filters = np.zeros((HASHES, 1 << 16), dtype=bool)
            filters[np.arange(HASHES)[:, None], values >> 16] = True
            self.partitions[1 << size] = np.array(members)[order], values, filters


def document_shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all rows, and the number of them before each row."""
    data = K.LOWER[data]
    starts, ends, before = K.words(data, offsets)
    counts = np.maximum(np.diff(before) - n + 1, 0)
    grams = K.Rolling(K.word_hashes(data, starts, ends)).windows(n)
    return grams[K.ranges(before[:-1], counts)], np.concatenate(([0], np.cumsum(counts)))


def search(items: Items, hashes: np.ndarray, before: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, item numbers) of candidates, with repeats."""
    if not len(hashes) or not items.partitions:
        return
    grids = {}
    for width in items.partitions:
        counts = -(-np.diff(before) // width)
        row = np.repeat(np.arange(len(counts)), counts)
        first = np.concatenate(([0], np.cumsum(counts)[:-1]))
        grids[width] = before[row] + (np.arange(len(row)) - first[row]) * width, row
    finest = min(grids)
    for j in range(HASHES):
        values = minhash(hashes, j)
        least = np.minimum.reduceat(values, grids[finest][0])
        at = grids[finest][0]
        for width, (starts, row) in grids.items():
            if width != finest:
                least = np.minimum.reduceat(least, np.searchsorted(at, starts))
                at = starts
            window = least.copy()
            window[:-1] = np.where(row[1:] == row[:-1], np.minimum(least[:-1], least[1:]), least[:-1])
            members, known, filters = items.partitions[width]
            near = np.flatnonzero(filters[j][window >> 16])
            lo, hi = (np.searchsorted(known[j], window[near], side) for side in ("left", "right"))
            if (count := hi - lo).any():
                yield np.repeat(row[near], count), members[j][K.ranges(lo, count)]


def chunk_leaks(items: Items, data: np.ndarray, offsets: np.ndarray, num: int, den: int) -> Iterator[tuple[int, int, int, int]]:
    """(row, item id, shared shingles, shingles of the item) of verified candidates."""
    found: dict[int, set[int]] = {}
    for rows, numbers in search(items, *document_shingles(data, offsets, items.n)):
        for row, number in set(zip(rows.tolist(), numbers.tolist())):
            found.setdefault(row, set()).add(number)
    for row, numbers in found.items():
        own = shingles(data[offsets[row] : offsets[row + 1]].tobytes(), items.n)
        for number in numbers:
            shared = len(items.sets[number] & own)
            if den * shared >= num * len(items.sets[number]):
                yield row, items.ids[number], shared, len(items.sets[number])


def leaks_in(docs: DataFrame, items: Items, num: int, den: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for lo, _, data, offsets in K.text_chunks(batch.column(1)):
                out = [(ids[lo + row].as_py(), *rest) for row, *rest in chunk_leaks(items, data, offsets, num, den)]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(4)], names=["doc_id", "item_id", "n_shared", "n_item"])

    return docs.mapInArrow(run, LEAKS)


def without_leaks(docs: DataFrame, items: Items, num: int, den: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, dtype=bool)
            for lo, _, data, offsets in K.text_chunks(batch.column("text")):
                keep[[lo + row for row, *_ in chunk_leaks(items, data, offsets, num, den)]] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def item_blocks(items: DataFrame, n: int) -> Iterator[Items]:
    """The items in blocks; a block never exceeds its bound by more than an item."""
    block, size = [], 0
    for row in items.select(F.col("item_id").cast("long").alias("item_id"), "text").toLocalIterator():  # a partition at a time
        length = len(row.text or "")
        if size + length > ITEM_BYTES and block:
            yield Items(block, n)
            block, size = [], 0
        block.append((row.item_id, row.text))
        size += length
    yield Items(block, n)


def leaks(docs: DataFrame, items: DataFrame, n: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item) of the items whose shingles are num / den or more in the document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return reduce(DataFrame.unionByName, [leaks_in(docs, block, num, den) for block in item_blocks(items, n)])


def clean(docs: DataFrame, items: DataFrame, n: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The documents, with all their columns, that hold no item; nothing is shuffled."""
    return reduce(lambda left, block: without_leaks(left, block, num, den), item_blocks(items, n), docs)
