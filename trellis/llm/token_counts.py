"""Token counts under a unigram vocabulary, without making the tokens.

Count-only Viterbi: an Aho-Corasick automaton enumerates the vocabulary's matches in the distinct segments of a batch;
dynamic programming carries, for each position, the best score and the number of pieces on the best path. Rules are those
of the usual unigram tokenizer: a later-starting piece replaces an earlier-starting one only with a greater score (starts
are visited from left to right), an unknown character scores ten below the least piece, and falls back to its UTF-8
bytes. Scores are added as doubles, exact for vocabularies of whole-number scores.

Text is cut at every place that no piece crosses: before a run of spaces that follows another character, and around characters
that no piece of two or more characters holds. The best path of the whole is then that of its segments, and equal
segments are solved once (a task remembers up to ``REMEMBERED`` of them, or those of one batch). All segments advance together, one character position at a time, in numpy.

Defined results: null counts as empty; an empty text has no tokens; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.llm.pieces import loaded

SPACE, UNKNOWN_PENALTY, BATCH, REMEMBERED = "▁", 10.0, 1 << 21, 1_000_000
COUNTS = "doc_id long, n_tokens long"
_LOADED: dict[bytes, UnigramCounter] = {}


class UnigramCounter:
    """Counts for the normal pieces (and their scores) of a model file, taken as a unigram vocabulary with byte fallback."""

    def __init__(self, model: bytes):
        pieces = loaded(model)
        table = {t.decode(): s for t, s, k in zip(pieces.texts, pieces.scores, pieces.kinds) if k in (1, 4)}
        if any(SPACE in x.lstrip(SPACE) for x in table):
            raise ValueError("a piece has a space after another character; segments would not be independent")
        self.prefix, self.scores = pieces.prefix, np.array(list(table.values()))
        self.unknown = min(self.scores, default=0.0) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for number, piece in enumerate(table):
            self.automaton.add_word(piece, number * 64 + min(63, len(piece)))
        self.long = {n: len(p) for n, p in enumerate(table) if len(p) > 62}
        self.automaton.make_automaton()
        joined = {c for p in table if len(p) > 1 for c in p}
        kept = "".join(re.escape(c) for c in sorted(joined - {SPACE}))
        self.segments = re.compile(f"{SPACE}*[{kept}]+|{SPACE}+|.", re.DOTALL)
        self.known: dict[str, int] = {}  # counts of segments met before, at most REMEMBERED of them

    def solve(self, segments: list[str]) -> np.ndarray:
        """The number of tokens of each (not empty) segment."""
        lengths = np.fromiter(map(len, segments), dtype=np.int64, count=len(segments))
        begin = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))  # one separator after each
        text = "\n".join(segments) + "\n" if not any("\n" in s for s in segments) else None
        if text is None:  # a segment is itself a line end: one character, solved apart
            line = np.array([s == "\n" for s in segments])
            out = np.zeros(len(segments), dtype=np.int64)
            out[line] = 1
            if not line.all():
                out[~line] = self.solve([s for s in segments if s != "\n"])
            return out
        found = np.fromiter(chain.from_iterable(self.automaton.iter(text)), dtype=np.int64).reshape(-1, 2)  # in order of end, then start
        end, number, size = found[:, 0] + 1, found[:, 1] >> 6, found[:, 1] & 63
        for n, length in self.long.items():
            size[number == n] = length
        codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        width = 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)  # UTF-8 bytes
        real = np.flatnonzero(codes != 10)
        single = np.zeros(len(codes) + 1, dtype=bool)
        single[end[size == 1]] = True
        lone = real[~single[real + 1]]  # characters without a piece of their own
        start = np.concatenate((end - size, lone))
        end = np.concatenate((end, lone + 1))
        score = np.concatenate((self.scores[number], np.full(len(lone), self.unknown)))
        pieces = np.concatenate((np.ones(len(number), dtype=np.int64), width[lone]))
        local = end - begin[np.searchsorted(begin, end, "left") - 1]
        order = np.argsort(end, kind="stable")  # merges two sorted runs
        order = order[np.argsort(local[order].astype(np.uint16 if lengths.max() < 65536 else np.int64), kind="stable")]  # a radix sort
        start, end, score, pieces, local = (x[order] for x in (start, end, score, pieces, local))
        best = np.full(len(codes) + 1, -np.inf)
        best[begin] = 0.0
        count = np.zeros(len(codes) + 1, dtype=np.int64)
        cut = np.searchsorted(local, np.arange(1, lengths.max() + 2))
        for a, b in zip(cut, cut[1:]):
            if a == b:
                continue
            total = best[start[a:b]] + score[a:b]
            ends = end[a:b]
            first = np.concatenate(([0], np.flatnonzero(ends[1:] != ends[:-1]) + 1))
            top = np.maximum.reduceat(total, first)
            size_of = np.diff(np.concatenate((first, [len(ends)])))
            hits = np.flatnonzero(total == np.repeat(top, size_of))
            group = np.repeat(np.arange(len(first)), size_of)[hits]
            hits = hits[np.concatenate(([True], group[1:] != group[:-1]))]  # of equal scores the earliest start
            best[ends[hits]] = total[hits]
            count[ends[hits]] = count[start[a:b][hits]] + pieces[a:b][hits]
        return count[begin + lengths]

    def counts(self, texts: list[str]) -> np.ndarray:
        found = [self.segments.findall((SPACE if self.prefix else "") + t.replace(" ", SPACE)) if t else [] for t in texts]
        new = list(set(chain.from_iterable(found)).difference(self.known))
        if len(self.known) + len(new) > REMEMBERED:
            self.known = {}
            new = list(set(chain.from_iterable(found)))
        if new:
            self.known.update(zip(new, self.solve(new).tolist()))
        known = self.known.__getitem__
        return np.array([sum(map(known, x)) for x in found], dtype=np.int64)


def counter(model: bytes) -> UnigramCounter:
    if model not in _LOADED:
        _LOADED[model] = UnigramCounter(model)
    return _LOADED[model]


def count_tokens(docs: DataFrame, model: bytes) -> DataFrame:
    """(doc_id, n_tokens) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        solver = counter(model)
        for batch in batches:
            lo, size, texts = 0, 0, batch.column(1).to_pylist()
            for hi, text in enumerate(texts, 1):
                size += len(text or "")
                if size >= BATCH or hi == len(texts):
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(solver.counts([t or "" for t in texts[lo:hi]]))], names=["doc_id", "n_tokens"])
                    lo, size = hi, 0

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, COUNTS)
