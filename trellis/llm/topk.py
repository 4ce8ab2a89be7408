"""Exact top-k by inner product: exhaustive term-at-a-time accumulation.

A query is a sparse row of (term, weight); the candidates of a block are an inverted index: for each term the
postings (row, weight) of the rows that have it. Terms are taken one at a time, each scattering weight * posting
into a dense array of scores; a partition step selects the k best of each query in the block, and a merge over blocks
keeps the k best of all.

Queries and candidates are dealt into blocks by a hash of their id, and every pair of blocks is one task of bounded
memory. Every candidate is scored. Scores are exact: they are summed as float32 or float64 only where the bound on any
partial sum fits the mantissa, else as int64.

Defined results: vectors that are null, empty or hold null or non-finite components take no part, nor do rows of null
id or a row that stands alone; of rows of equal id each is a query and a candidate of its own; ties go to the smaller id; a row is never its own candidate (rows of equal id neither); fewer than k
candidates give fewer rows; vectors of different lengths are compared over the terms that both have.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK, ROW_BLOCK, TILE = 4096, 16384, 128
PAIRS = "query_id long, vec_id long, score long"


def quantised(embedding: Column, scale: int = 64) -> Column:
    """floor(scale * x) of every component as long; null unless all are finite."""
    usable = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(usable & (F.size(embedding) > 0), F.transform(embedding, lambda x: F.floor(x.cast("double") * F.lit(scale))))


def postings(rows: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """term -> (rows, weights), without zero weights."""
    order = np.argsort(terms, kind="stable")
    order = order[weights[order] != 0]
    if not len(order):
        return {}
    terms = terms[order]
    cut = np.concatenate(([0], np.flatnonzero(terms[1:] != terms[:-1]) + 1, [len(terms)]))
    return {int(terms[a]): (rows[order[a:b]], weights[order[a:b]]) for a, b in zip(cut, cut[1:])}


def search_block(query_ids: np.ndarray, query_rows: list[np.ndarray], row_ids: np.ndarray, rows: list[np.ndarray], k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The k best of ``rows`` for each query, ties to the smaller id: (query ids, row ids, scores) by tile."""
    by_id = np.argsort(row_ids, kind="stable")  # equal scores are then in order of id
    row_ids, rows = row_ids[by_id], [rows[i] for i in by_id]
    sizes = np.array([len(x) for x in rows])
    terms = np.concatenate([np.arange(n) for n in sizes])
    index = postings(np.repeat(np.arange(len(rows)), sizes), terms, np.concatenate(rows))
    most = lambda vectors: max(float(np.abs(x.astype(np.float64)).max()) for x in vectors)
    bound = most(query_rows) * most(rows) * max(sizes.max(), 1)
    kind = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64
    index = {t: (at if len(at) < len(rows) else slice(None), w.astype(kind)) for t, (at, w) in index.items()}
    for lo in range(0, len(query_rows), TILE):
        tile = query_rows[lo : lo + TILE]
        scores = np.zeros((len(tile), len(rows)), dtype=kind)
        for q, vector in enumerate(tile):
            own = scores[q]
            for term in np.flatnonzero(vector):
                if (found := index.get(int(term))) is not None:
                    own[found[0]] += kind(vector[term]) * found[1]
        ids = query_ids[lo : lo + TILE]
        same = np.searchsorted(row_ids, ids, "left"), np.searchsorted(row_ids, ids, "right")
        for q in range(len(tile)):
            own = scores[q]
            away = np.ones(len(rows), dtype=bool)
            away[same[0][q] : same[1][q]] = False
            left = np.flatnonzero(away)
            if len(left) > k:
                cut = np.partition(own[left], len(left) - k)[len(left) - k]
                above = left[own[left] > cut]
                left = np.concatenate((above, left[own[left] == cut][: k - len(above)]))
            if len(left):
                yield np.full(len(left), ids[q]), row_ids[left], own[left].astype(np.int64)


def top_k(queries: DataFrame, rows: DataFrame, k: int, query_block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best rows of each query.

    Both inputs are (vec_id long, vector array<long>), vectors not null. The number of blocks follows the counts, so a
    task holds about ``query_block`` queries, ``row_block`` rows and ``TILE`` arrays of scores. Work and rows sent grow as
    queries times rows / block size, as exhaustive search must.
    """
    queries, rows = queries.filter("vec_id is not null"), rows.filter("vec_id is not null")
    blocks = lambda df, size: max(1, -(-df.count() // size))
    n_query, n_row = blocks(queries, query_block), blocks(rows, row_block)
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select(deal(n_query).alias("q"), every(n_row).alias("r"), "vec_id", "vector")
    right = rows.select(every(n_query).alias("q"), deal(n_row).alias("r"), "vec_id", "vector")

    def vectors(table: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
        lists = table.column("vector").combine_chunks()
        ends, flat = np.asarray(lists.offsets), lists.values.to_numpy(zero_copy_only=False)
        return table.column("vec_id").to_numpy(), [flat[a:b] for a, b in zip(ends, ends[1:])]

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        found = list(search_block(*vectors(a), *vectors(b), k)) if a.num_rows and b.num_rows else []
        columns = [np.concatenate(x) if found else np.empty(0, np.int64) for x in (list(zip(*found)) or [[], [], []])]
        return pa.table([pa.array(x, pa.int64()) for x in columns], names=["query_id", "vec_id", "score"])

    best = left.groupBy("q", "r").cogroup(right.groupBy("q", "r")).applyInArrow(run, PAIRS)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
