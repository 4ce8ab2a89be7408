"""N-gram Jaccard join: exact, by T-occurrence search.

Documents of equal shingle sets form a class; its member of least id stands for it. Shingles are put in one order, those that
are rare in the corpus first: a sketch of fixed size counts all shingles, and ties go by hash. Two sets of Jaccard similarity t
or more share a shingle among the first n - ceil(t * n) + 1 of each, the *prefix*. Sets that meet under a prefix shingle, in
pairs of fitting sizes, are compared by parity signatures, whose distance never exceeds that of the sets: what differs in too
many bits is no link, what is left is *plausible*. Components of plausible pairs are *families*; no link leads out of one.
A shingle that stands in more than ``WIDE`` prefixes gives no pairs: its sets are one family, unseen.

In a family the T-occurrence search finds the links: for each set it takes the inverted lists of its shingles in a block of
sets; short ones are merged, the L longest are probed by binary search for the candidates that the merge left with T - L
occurrences (DivideSkip), and those that reach the exact required overlap are links. Large families are dealt into blocks.
Each block is searched on its own, with the family's first set in each; then only what is outside the family's largest
component meets the other blocks, as pairs inside a component have nothing to add. Blocks give a spanning forest of their
links, never all pairs, and components follow from the forests.

Nothing grows on the driver: the sketch's levels (``1 << SKETCH_BITS`` bytes) and a bitmap of the families' ids
(``common.parted``, which spares sending texts that are in no family) have fixed sizes.

Defined results: words are runs of bytes other than white space, A-Z lower-cased; fewer words than n make one shingle; null
texts and texts without words have an empty set and link with nothing; equal sets link; rows of equal id are one document,
which has the links of each of its texts (n_shingles is the row's own); a null doc_id gets a null component and links with
nothing; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.llm import kernels as K
from trellis.llm.common import materialise, parted, release
from trellis.llm.graph import components

SKETCH_BITS = 18
WIDE, WIDEST, BLOCK, BLOCK_SHINGLES, LARGEST = 64, 8192, 256, 1 << 18, 4096
LEAST_BITS, MOST_BITS = 6, 14
SETS = "doc_id long, n long, a long, b long, bits binary"
_SALT = [K.U64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row of a chunk."""
    data = K.LOWER[data]
    starts, ends, before = K.words(data, offsets)
    roll = K.Rolling(K.word_hashes(data, starts, ends))
    grams = roll.windows(n)
    for lo, hi in zip(before[:-1].tolist(), before[1:].tolist()):
        if hi - lo >= n:
            yield np.unique(grams[lo : hi - n + 1])
        elif hi > lo:
            yield roll.slices(np.array([lo]), np.array([hi]))
        else:
            yield grams[:0]


def digests(sets: list[np.ndarray], salt: np.uint64) -> np.ndarray:
    return np.array([K.mix(x ^ salt).sum(dtype=np.uint64) for x in sets], dtype=np.uint64)


def buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> K.U64(64 - SKETCH_BITS)).astype(np.int64)


def levels(docs: DataFrame, n: int) -> np.ndarray:
    """How common the shingles of each bucket of the sketch are, over all documents, in steps of a factor of the square root of 2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
        for batch in batches:
            for _, _, data, offsets in K.text_chunks(batch.column(0)):
                counts += np.bincount(buckets(np.concatenate(list(shingle_sets(data, offsets, n)))), minlength=len(counts))
        at = np.flatnonzero(counts)
        for lo in range(0, len(at), 1 << 16):
            part = at[lo : lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(counts[part])], names=["bucket", "c"])

    found = docs.select("text").mapInArrow(run, "bucket int, c long").groupBy("bucket").agg(F.floor(2 * F.log2(F.sum("c"))).cast("int").alias("level"))
    found = found.toArrow()  # one row for each bucket of the sketch at most
    out = np.zeros(1 << SKETCH_BITS, dtype=np.uint8)
    out[found.column("bucket").to_numpy()] = found.column("level").to_numpy()
    return out


def prefix(hashes: np.ndarray, level: np.ndarray, num: int, den: int) -> np.ndarray:
    """The shingles of a set among whose first, rarest first, one is common to any two sets of similarity num / den or more."""
    size = len(hashes)
    if not size:
        return hashes
    order = np.argsort(level[buckets(hashes)], kind="stable")  # the hashes are sorted: ties go by hash
    return hashes[order[: size - -(-size * num // den) + 1]]


def signature(hashes: np.ndarray) -> bytes:
    """Parities of the set's hashes in a power of two of bits that follows the set's size."""
    width = 1 << min(MOST_BITS, max(LEAST_BITS, (len(hashes) - 1).bit_length() if len(hashes) else 0))
    at = ((hashes * _SALT[2]) >> K.U64(40)).astype(np.int64) & (width - 1)
    return np.packbits((np.bincount(at, minlength=width) & 1).astype(np.uint8), bitorder="little").tobytes()


def sketches(docs: DataFrame, n: int) -> DataFrame:
    """Size, two hashes and signature of each document's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in K.text_chunks(batch.column(1)):
                sets = list(shingle_sets(data, offsets, n))
                hashes = [pa.array(K.signed(digests(sets, salt))) for salt in _SALT[:2]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([len(x) for x in sets], pa.int64()), *hashes, pa.array([signature(x) for x in sets], pa.binary())], names=["doc_id", "n", "a", "b", "bits"])

    return docs.select("doc_id", "text").mapInArrow(run, SETS)


def prefix_keys(docs: DataFrame, level: np.ndarray, n: int, num: int, den: int) -> DataFrame:
    """(key, a, n): the prefix shingles of each document's set, with the set's first hash and size; a task gives equal sets once.
    Made anew for each of its two uses: a second pass over the texts costs less than keys on disk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, _, data, offsets in K.text_chunks(batch.column(0)):
                sets = [x for x in shingle_sets(data, offsets, n) if len(x)]
                named = digests(sets, _SALT[0]).view(np.int64).tolist()
                new = [i for i, a in enumerate(named) if not (a in seen or seen.add(a))]
                if new:
                    keys = [prefix(sets[i], level, num, den) for i in new]
                    count = [len(x) for x in keys]
                    own, size = np.repeat(np.array([named[i] for i in new]), count), np.repeat(np.array([len(sets[i]) for i in new]), count)
                    yield pa.RecordBatch.from_arrays([pa.array(K.signed(np.concatenate(keys))), pa.array(own), pa.array(size)], names=["key", "a", "n"])

    return docs.select("text").mapInArrow(run, "key long, a long, n long")


def folded(bits: np.ndarray, width: int) -> np.ndarray:
    """Signatures (rows of bytes) brought to a smaller width."""
    return np.bitwise_xor.reduce(bits.reshape(len(bits), -1, width), axis=1)


def near(sizes: np.ndarray, bits: list[list[bytes]], num: int, den: int) -> np.ndarray:
    """Which pairs of sets (sizes of shape (2, pairs), signatures of both) may have similarity num / den or more."""
    total = sizes.sum(axis=0)
    most = total - 2 * -(-num * total // (num + den))
    widths = np.array([[len(x) for x in side] for side in bits])
    out = np.zeros(len(total), dtype=bool)
    for x, y in set(zip(*widths.tolist())):
        at = np.flatnonzero((widths[0] == x) & (widths[1] == y))
        sides = [folded(np.frombuffer(b"".join(bits[k][i] for i in at), dtype=np.uint8).reshape(len(at), -1), min(x, y)) for k in (0, 1)]
        out[at] = np.bitwise_count(np.ascontiguousarray(sides[0] ^ sides[1]).view(np.uint64)).sum(axis=1) <= most[at]
    return out


class Signatures:
    """The signatures of some sets, by their width."""

    def __init__(self, sizes: np.ndarray, bits: list[bytes], num: int, den: int):
        self.sizes, self.num, self.den = sizes, num, den
        widths = np.array([len(x) for x in bits])
        self.parts = []
        for width in np.unique(widths):
            at = np.flatnonzero(widths == width)
            self.parts.append((at, np.frombuffer(b"".join(bits[i] for i in at), dtype=np.uint8).reshape(len(at), -1)))
        self.own = {int(i): matrix[k] for at, matrix in self.parts for k, i in enumerate(at)}

    def like(self, one: int) -> np.ndarray:
        """The sets that may be similar to set ``one``, itself among them."""
        out = []
        for at, matrix in self.parts:
            total = self.sizes[at] + self.sizes[one]
            width = min(matrix.shape[1], len(self.own[one]))
            far = np.bitwise_count(np.ascontiguousarray(folded(matrix, width) ^ folded(self.own[one][None], width)).view(np.uint64)).sum(axis=1)
            fits = np.minimum(self.sizes[at], self.sizes[one]) * self.den >= np.maximum(self.sizes[at], self.sizes[one]) * self.num
            out.append(at[fits & (far <= total - 2 * -(-self.num * total // (self.num + self.den)))])
        return np.concatenate(out)


def plausible_forest(sizes: np.ndarray, bits: list[bytes], num: int, den: int) -> list[tuple[int, int]]:
    """Pairs (ordinals) that join up what pairs of possibly similar sets join."""
    known = Signatures(sizes, bits, num, den)
    label = np.arange(len(sizes))
    asked = np.zeros(len(sizes), dtype=bool)
    out = []
    while True:
        count = np.bincount(label, minlength=len(sizes))
        todo = np.flatnonzero(~asked & (label != count.argmax()) if asked.any() else ~asked)
        if not len(todo):
            return out
        one = int(todo[0])
        asked[one] = True
        for part in np.unique(label[known.like(one)]):
            if part != label[one]:
                out.append((one, int(np.flatnonzero(label == part)[0])))
                label[label == part] = label[one]


def wide_forests(rows: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): forests of the plausible pairs in each key of ``rows`` (key, rep, n, bits), which are sorted by key in their partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            reps = table.column("rep").to_numpy()
            found = plausible_forest(table.column("n").to_numpy(), table.column("bits").to_pylist(), num, den)
            return pa.RecordBatch.from_arrays([pa.array([int(reps[x[k]]) for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            keys = batch.column("key").to_numpy()
            cut = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for lo, hi in zip(cut, cut[1:]):
                if held and hi > lo and held[0].column("key")[0].as_py() != keys[lo]:
                    yield flush()
                    held.clear()
                if hi > lo:
                    held.append(batch.slice(lo, hi - lo))
        if held:
            yield flush()

    return rows.mapInArrow(run, "a long, b long")


def plausible(docs: DataFrame, classes: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(a, b): pairs of class members of least id that hold every link between classes, joined up where a shingle is in many prefixes."""
    keys = prefix_keys(docs, levels(docs, n), n, num, den)
    shared = materialise(keys.groupBy("key").agg(F.min("a").alias("lo"), F.max("a").alias("hi")).filter("lo < hi").select("key"), "keys")
    members = materialise(keys.join(shared, "key", "left_semi").distinct(), "members")
    wide = materialise(members.groupBy("key").agg(F.count("*").alias("c"), F.min("a").alias("hub")).filter(F.col("c") > WIDE), "wide")
    few = members.join(wide, "key", "left_anti")
    left, right = few.select("key", F.col("a").alias("x"), F.col("n").alias("nx")), few.select("key", F.col("a").alias("y"), F.col("n").alias("ny"))
    fits = (F.col("x") < F.col("y")) & (F.least("nx", "ny") * den >= F.greatest("nx", "ny") * num)
    pairs = materialise(left.join(right, "key").filter(fits).select("x", "y").distinct(), "pairs")
    with_bits = lambda k: classes.select(F.col("a").alias(k), F.col("rep").alias(f"rep_{k}"), F.col("n").alias(f"n_{k}"), F.col("bits").alias(f"bits_{k}"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([batch.column(f"n_{k}").to_numpy() for k in "xy"])
            ok = pa.array(near(sizes, [batch.column(f"bits_{k}").to_pylist() for k in "xy"], num, den))
            yield pa.RecordBatch.from_arrays([batch.column(f"rep_{k}").filter(ok) for k in "xy"], names=["a", "b"])

    checked = pairs.join(with_bits("x"), "x").join(with_bits("y"), "y").mapInArrow(check, "a long, b long")
    reps = classes.select("a", "rep")
    in_wide = members.join(wide.filter(F.col("c") <= WIDEST).select("key"), "key", "left_semi").select("key", "a").join(classes.select("a", "rep", "n", "bits"), "a")
    joined = wide_forests(in_wide.select("key", "rep", "n", "bits").repartition("key").sortWithinPartitions("key", "rep"), num, den).distinct()
    stars = members.join(wide.filter(F.col("c") > WIDEST).select("key", "hub"), "key").filter("a <> hub").select("a", "hub").distinct().join(reps, "a").select("hub", F.col("rep").alias("b"))
    stars = stars.join(reps.withColumnRenamed("a", "hub"), "hub").select(F.col("rep").alias("a"), "b")
    out = materialise(checked.unionByName(joined).unionByName(stars), "plausible")
    release(shared, members, wide, pairs)
    return out


class Index:
    """Inverted lists of the shingles of a block; ordinals are in order of set size."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(x) for x in sets])
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        self.items = np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.terms, first = np.unique(flat[order], return_index=True)
        self.ends = np.concatenate((first, [len(flat)]))

    def search(self, query: np.ndarray, num: int, den: int) -> np.ndarray:
        """Ordinals of the sets whose Jaccard similarity with ``query`` is num / den or more."""
        size = len(query)
        needed = lambda other: -(-num * (size + other) // (num + den))
        low, high = np.searchsorted(self.sizes, [-(-num * size // den), den * size // num + 1])
        at = np.minimum(np.searchsorted(self.terms, query), len(self.terms) - 1)
        at = at[self.terms[at] == query]
        least = int(needed(-(-num * size // den)))
        if low >= high or len(at) < least:
            return at[:0]
        lengths = self.ends[at + 1] - self.ends[at]
        at = at[np.argsort(lengths, kind="stable")]
        skip = min(least - 1, int(least / (0.25 * np.log2(max(2, lengths.max())) + 1)))
        lists = [self.items[self.ends[i] : self.ends[i + 1]] for i in at.tolist()]
        merged = np.sort(np.concatenate(lists[: len(lists) - skip]), kind="stable")
        merged = merged[(merged >= low) & (merged < high)]
        found, count = np.unique(merged, return_counts=True)
        for left in range(skip, -1, -1):  # ``left`` long lists are still to be probed
            alive = count >= least - left
            found, count = found[alive], count[alive]
            if not len(found) or not left:
                break
            probe = lists[len(lists) - left]
            where = np.minimum(np.searchsorted(probe, found), len(probe) - 1)
            count = count + (probe[where] == found)
        return found[count >= needed(self.sizes[found])]


def forest(ids: np.ndarray, sets: list[np.ndarray], queries: np.ndarray, rows: np.ndarray, labels: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Links that join up what is linked between ``queries`` and ``rows`` (ordinals), beyond what ``labels`` join already.

    A pair in one component has nothing to add, so queries of the largest component wait for the others; the rest of
    them needs no search if in the end they are all of one component and the queries are the rows."""
    order = np.argsort([len(sets[i]) for i in rows], kind="stable")
    rows = rows[order]
    index = Index([sets[i] for i in rows])
    _, parent = np.unique(labels, return_inverse=True)
    of = parent.copy()
    parent = list(range(int(of.max()) + 1))
    size = np.bincount(of).tolist()

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    out = []

    def take(q: int) -> None:
        for other in rows[index.search(sets[q], num, den)].tolist():
            x, y = root(of[q]), root(of[other])
            if x != y:
                x, y = min(x, y), max(x, y)
                parent[y] = x
                size[x] += size[y]
                out.append((int(ids[q]), int(ids[other])))

    inside = len(queries) == len(rows) and set(queries.tolist()) == set(rows.tolist())
    left = queries.tolist()
    while left:
        largest = max((root(x) for x in set(of[left].tolist())), key=lambda r: size[r]) if inside else -1
        wait = []
        for k, q in enumerate(left):
            if k and root(of[q]) == root(largest):
                wait.append(q)
            else:
                take(q)
                largest = max(root(largest), root(of[q]), key=lambda r: size[r]) if inside else -1
        if inside and len({root(of[q]) for q in wait}) <= 1:
            break
        left = wait
    return out


def arrays(table: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype=np.uint64) for x in table.column("shingles").to_pylist()]


def family_sets(docs: DataFrame, members: DataFrame, n: int) -> DataFrame:
    """(doc_id, family, n, blocks, block, hub, shingles) of the documents of ``members`` (those columns but the last, and a)."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in K.text_chunks(batch.column(1)):
                found = list(shingle_sets(data, offsets, n))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(K.signed(digests(found, _SALT[0]))), pa.array([x.tobytes() for x in found], pa.binary())], names=["doc_id", "a", "shingles"])

    rows = parted(docs.select("doc_id", "text"), members)[1].mapInArrow(sets, "doc_id long, a long, shingles binary")
    return rows.join(members, ["doc_id", "a"]).drop("a")


def links(docs: DataFrame, families: DataFrame, classes: DataFrame, n: int, num: int, den: int) -> list[DataFrame]:
    """Tables (a, b) of links that connect what is connected, between the documents of ``families`` (doc_id, family)."""
    rows = families.join(classes.select(F.col("rep").alias("doc_id"), "a", "n"), "doc_id")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    size = materialise(rows.groupBy("family").agg(F.count("*").alias("m"), blocks.alias("blocks"), F.sum("n").alias("shingles_of")).filter("m > 1"), "sizes")
    block = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int").alias("block")
    sets = materialise(family_sets(docs, rows.join(size, "family").select("doc_id", "family", "a", "m", "blocks", block), n), "sets")

    def one(table: pa.Table) -> pa.Table:
        ids, every = table.column("doc_id").to_numpy(), np.arange(table.num_rows)
        found = forest(ids, arrays(table), every, every, ids, num, den)
        return pa.table([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    hub = (F.col("doc_id") == F.col("family")) & (F.col("blocks") > 1)
    dealt = sets.withColumn("block", F.explode(F.when(hub, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))))
    first = materialise(dealt.select("family", "block", "doc_id", "shingles").groupBy("family", "block").applyInArrow(one, "a long, b long"), "links")
    large = sets.filter("blocks > 1")
    if large.isEmpty():
        release(size, sets)
        return [first]
    parts = components(first)
    label = materialise(large.select("doc_id", "family", "m").join(parts, F.col("doc_id") == F.col("node"), "left").select("doc_id", "family", "m", F.coalesce("component", "doc_id").alias("label")), "labels")
    main = label.groupBy("family", "label").agg(F.count("*").alias("c")).groupBy("family").agg(F.max_by("label", F.struct("c", "label")).alias("main"))
    rest = materialise(label.join(main, "family").filter("label <> main").select("doc_id", "family"), "rest")
    # a side's blocks grow with the family, so that what is sent grows in proportion to it up to 4 * LARGEST sets
    side = F.least(F.greatest(F.ceil(F.sqrt(F.col("m") * F.col("r")) / 4), F.lit(BLOCK)), F.lit(LARGEST))
    parts_of = lambda k: F.greatest(F.ceil(F.col(k) / F.col("side")), F.ceil(F.col("shingles_of") * F.col(k) / F.col("m") / (4 * BLOCK_SHINGLES))).cast("int")
    grid = rest.groupBy("family").agg(F.count("*").alias("r")).join(size, "family").withColumn("side", side)
    grid = materialise(grid.select("family", parts_of("r").alias("q"), parts_of("m").alias("s")), "grid")
    laid = large.select("doc_id", "family", "shingles").join(label.select("doc_id", "label"), "doc_id").join(grid, "family")
    deal = lambda k: F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    asked = laid.join(rest.select("doc_id"), "doc_id", "left_semi").select("family", deal("q").alias("i"), every("s").alias("j"), F.lit(True).alias("asks"), "doc_id", "label", "shingles")
    held = laid.select("family", every("q").alias("i"), deal("s").alias("j"), F.lit(False).alias("asks"), "doc_id", "label", "shingles")

    def two(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy()
        found = forest(table.column("doc_id").to_numpy(), arrays(table), np.flatnonzero(asks), np.flatnonzero(~asks), table.column("label").to_numpy(), num, den) if asks.any() and not asks.all() else []
        return pa.table([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    second = materialise(asked.unionByName(held).groupBy("family", "i", "j").applyInArrow(two, "a long, b long"), "links")
    release(size, sets, label, rest, grid)
    return [first, second]


def jaccard_join(docs: DataFrame, n: int = 3, num: int = 9, den: int = 10) -> DataFrame:
    """(doc_id, n_shingles, component_id): links are pairs of similarity num / den or more of their n-word shingle sets."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    all_sets = materialise(sketches(docs, n), "sketches")
    full = all_sets.filter("n > 0 and doc_id is not null")
    classes = materialise(full.groupBy("n", "a", "b").agg(F.min("doc_id").alias("rep"), F.max("bits").alias("bits")), "classes")
    near = plausible(docs.filter("doc_id is not null"), classes, n, num, den)
    families = materialise(components(near).select(F.col("node").alias("doc_id"), F.col("component").alias("family")), "families")
    found = links(docs, families, classes, n, num, den)
    rep_of = materialise(full.select("doc_id", "n", "a", "b").join(classes.drop("bits"), ["n", "a", "b"]).select("doc_id", "n", "rep"), "reps")
    repeated = rep_of.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("hi")).filter("a < hi").select("doc_id", "a")  # ids of several texts
    same = rep_of.join(repeated, "doc_id").select("a", F.col("rep").alias("b"))
    parts = materialise(components(found[0].unionByName(found[-1]).unionByName(same)), "parts")  # a table, so that a hot class can be split in the join
    linked = rep_of.join(parts, F.col("rep") == F.col("node"), "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
    out = materialise(linked.unionByName(all_sets.filter("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))), "joined")
    release(all_sets, classes, near, families, *found, rep_of, parts)
    return out
