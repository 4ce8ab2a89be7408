"""Burrows-Wheeler transforms of string collections, merged by iterative interleave refinement.

A shard's strings each end in a terminator of their own. ``shard`` sorts the shard's suffixes once. ``merge`` never sorts suffixes: it
holds, for each place of the merged transform, the shard it comes from, starting with the shards one after the other, and refines that
interleave by stable distribution on the transforms' symbols; after h rounds it is in order of the first h symbols. The round in which
two neighbours part is their common prefix. Places that are still together after ``depth`` rounds begin with the same ``depth`` symbols:
repeated intervals.

Rounds cost the whole collection each, ``depth`` of them, which the README's figures weigh against minimiser paths.
"""

from __future__ import annotations

import numpy as np


def shard(strings: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(transform, suffix starts) of the strings laid one after the other, terminators included; symbols are byte + 1, 0 ends a string.
    Suffixes are in order of their first ``depth`` symbols; equal ones stay in order of place."""
    flat = np.concatenate([np.append(np.frombuffer(s, dtype=np.uint8).astype(np.int64) + 1, 0) for s in strings])
    n = len(flat)
    ends = np.flatnonzero(flat == 0)
    rank, width = flat.copy(), 1
    rank[ends] = np.arange(len(ends))  # terminators differ, and come first
    rank[flat > 0] += len(ends)
    while width < depth:
        stop = ends[np.searchsorted(ends, np.arange(n))]
        ahead = np.minimum(np.arange(n) + width, stop)
        _, rank = np.unique(rank * (rank.max() + 1) + rank[ahead], return_inverse=True)
        width *= 2
    order = np.argsort(rank, kind="stable")
    before = np.where(order > 0, order - 1, 0)
    symbols = np.where(order > 0, flat[before], 0)
    return symbols, order


def merge(shards: list[tuple[np.ndarray, np.ndarray]], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(interleave, common prefixes): the shard at each place of the merged transform, and the symbols that the place shares with the one
    before it, ``depth`` if that many or more."""
    sizes = [len(t) for t, _ in shards]
    source = np.repeat(np.arange(len(shards)), sizes)
    ends = [int((t == 0).sum()) for t, _ in shards]
    shared = np.full(sum(sizes), depth, dtype=np.int64)
    shared[0] = 0
    block = np.zeros(len(source), dtype=np.int64)
    for h in range(1, depth + 1):
        symbols = np.empty(len(source), dtype=np.int64)
        for k, (transform, _) in enumerate(shards):
            symbols[source == k] = transform
        inner = np.flatnonzero(symbols > 0)
        order = inner[np.argsort(symbols[inner].astype(np.uint16), kind="stable")]  # a radix sort
        # terminators keep their place in front, shard after shard
        new = np.concatenate([np.repeat(np.arange(len(shards)), ends), source[order]])
        part = np.concatenate([np.arange(sum(ends)), sum(ends) + (np.concatenate(([0], np.cumsum((symbols[order][1:] != symbols[order][:-1]) | (block[order][1:] != block[order][:-1])))) if len(order) else order)])
        cut = np.concatenate(([True], part[1:] != part[:-1]))
        shared[cut & (shared == depth)] = h - 1
        shared[0] = 0
        if (new == source).all() and (part == block).all():
            break
        source, block = new, part
    return source, shared


def repeated_starts(collections: list[list[bytes]], depth: int) -> list[list[set[int]]]:
    """For each shard and string the starts of ``depth``-byte substrings that occur more than once in all shards."""
    shards = [shard(strings, depth) for strings in collections]
    source, shared = merge(shards, depth)
    same = shared >= depth
    hit = same | np.append(same[1:], False)
    out = []
    for k, strings in enumerate(collections):
        starts = shards[k][1][hit[source == k]]
        at = np.concatenate(([0], np.cumsum([len(s) + 1 for s in strings])))
        which = np.searchsorted(at, starts, "right") - 1
        found: list[set[int]] = [set() for _ in strings]
        for i, p in zip(which.tolist(), starts.tolist()):
            if p - at[i] + depth <= len(strings[i]):
                found[i].add(int(p - at[i]))
        out.append(found)
    return out
