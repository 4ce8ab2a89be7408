"""SentencePiece encoding and decoding with original byte spans.

A model's compiled character map (a double-array trie and a table of replacements) is walked by longest prefix;
every normalised byte records the source byte it came from, through the dummy prefix, the escape of spaces and the
removal of extra white space. The library segments the text; the lengths of its pieces, laid over the normalised
bytes, give each piece's span in the source. Pieces are held against the normalised text.

Defined results: null encodes as empty; an empty text has begin and end ids only; begin and end ids and pieces that
come from nothing (the dummy prefix alone) have empty spans; spans of byte-fallback pieces are single bytes, and spans
over a replaced sequence cover all of it; a text whose pieces don't spell its normalised form (none is known) has empty
spans throughout; rows of null or equal id are encoded each for itself; extra columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ESCAPE = "▁".encode()
SPANS = "doc_id long, ids array<int>, decoded string, starts array<int>, stops array<int>"


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                return value
            shift += 7

    while at < len(data):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield number, data[at : at + size]
            at += size


class CharacterMap:
    """Longest-prefix replacement by a compiled map: a little-endian size, a double-array trie, NUL-ended strings."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, dtype="<u4", count=size // 4, offset=4).tolist() if blob else []
        self.strings = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, int]:
        """(bytes matched, offset of the replacement); no match: 0 bytes."""
        units, best, length = self.units, (0, 0), 0
        offset = lambda u: (u >> 10) << ((u & (1 << 9)) >> 6)
        node = offset(units[0])
        for byte in data[at:]:
            node ^= byte
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != byte:
                break
            length += 1
            node ^= offset(unit)
            if unit >> 8 & 1:
                best = length, units[node] & 0x7FFFFFFF
        return best

    def replacement(self, offset: int) -> bytes:
        return self.strings[offset : self.strings.index(b"\0", offset)]


class Pieces:
    """A model with its normaliser."""

    def __init__(self, model: bytes):
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        spec: dict[int, int | bytes] = {}
        lengths, kinds, scores, texts = [], [], [], []
        for number, value in fields(model):
            if number == 1:
                piece = dict(fields(value))
                texts.append(piece[1])
                kinds.append(piece.get(3, 1))
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                lengths.append({2: -1, 3: 0, 6: 1}.get(kinds[-1], len(piece[1])))
            elif number == 3:
                spec = dict(fields(value))
        self.texts, self.kinds, self.scores = texts, kinds, scores
        self.lengths = np.array(lengths, dtype=np.int64)
        self.map = CharacterMap(spec.get(2, b""))
        self.prefix, self.trim, self.escape = (bool(spec.get(n, 1)) for n in (3, 4, 5))

    def normalise(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, and the source offset at which each of them begins (and one past the end)."""
        space = ESCAPE if self.escape else b" "
        if not self.map.units and not self.trim:
            data = np.frombuffer(text, dtype=np.uint8)
            if not len(data):
                return b"", np.zeros(1, dtype=np.int64)
            width = np.where(data == 0x20, len(space), 1)
            at = np.repeat(np.arange(len(data)), width)
            out = text.replace(b" ", space)
            if self.prefix:
                out, at = space + out, np.concatenate((np.zeros(len(space), dtype=np.int64), at))
            return out, np.concatenate((at, [len(data)]))
        steps, i = [], 0
        while i < len(text):
            used, offset = self.map.longest(text, i) if self.map.units else (0, 0)
            if used:
                steps.append((i, self.map.replacement(offset)))
            else:
                lead = text[i]
                used = 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                steps.append((i, text[i : i + used]))
            i += used
        out, at, end = bytearray(), [], len(text)
        if self.trim:
            while steps and not steps[0][1].strip(b" "):
                steps.pop(0)
            while steps and not steps[-1][1].strip(b" "):
                end = steps.pop()[0]
        if steps and self.prefix:
            out += space
            at += [steps[0][0]] * len(space)
        blank = self.trim
        for source, piece in steps:
            for byte in piece:
                if byte == 0x20 and self.trim and blank:
                    continue
                blank = byte == 0x20
                new = space if byte == 0x20 else bytes((byte,))
                out += new
                at += [source] * len(new)
        while self.trim and out.endswith(space):
            del out[-len(space) :], at[-len(space) :]
        return bytes(out), np.array([*at, end], dtype=np.int64)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, add_bos=True, add_eos=True, num_threads=1)

    def decode(self, ids: list[list[int]]) -> list[str]:
        return [self.library.decode(x) for x in ids]

    def spans(self, text: str, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Source byte spans (starts, stops) of the pieces of ``ids``, begin and end ids included."""
        source = text.encode()
        normal, at = self.normalise(source)
        ids = np.asarray(ids)
        lengths = self.lengths[ids]
        if (unknown := np.flatnonzero(lengths < 0)).size:  # an unknown piece covers whatever the known ones leave
            known = [self.texts[i] for i in ids]
            lengths = lengths.copy()
            here = 0
            for n, i in enumerate(ids):
                if lengths[n] < 0:
                    rest = next((known[m] for m in range(n + 1, len(ids)) if lengths[m] > 0), None)
                    stop = len(normal) if rest is None else normal.index(rest, here + 1)
                    lengths[n] = stop - here
                here += lengths[n]
        ends = np.cumsum(lengths)
        if len(ends) and ends[-1] != len(normal):  # the pieces don't spell the normalised text: no spans
            return np.zeros(len(ids), dtype=np.int64), np.zeros(len(ids), dtype=np.int64)
        starts = at[ends - lengths]
        last = at[np.maximum(ends - 1, 0)]
        after = at[np.minimum(np.searchsorted(at, last, "right"), len(at) - 1)]  # where what the last byte came from is over
        dummy = len(ESCAPE if self.escape else b" ") if self.prefix else 0
        stops = np.where((lengths > 0) & (ends > dummy), np.maximum(after, starts), starts)
        return starts, stops


_LOADED: dict[bytes, Pieces] = {}


def loaded(model: bytes) -> Pieces:
    if model not in _LOADED:
        _LOADED[model] = Pieces(model)
    return _LOADED[model]


def encode_decode(docs: DataFrame, model: bytes, finish: tuple[Callable[[pa.RecordBatch], pa.RecordBatch], str] | None = None) -> DataFrame:
    """(doc_id, ids, decoded, starts, stops) of every whole text.

    ``model`` is the content of a model file (a few MB at most, sent with the task). ``finish``, a function on the
    result's batches and the schema it gives, runs in the same pass, so that ids which only feed a digest never
    leave the Python worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(model)
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                texts = [x or "" for x in batch.column(1).to_pylist()]
                ids = pieces.encode(texts)
                both = [pieces.spans(t, i) for t, i in zip(texts, ids)]
                offsets = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in ids]))), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (np.concatenate(ids).astype(np.int32), *(np.concatenate([x[n] for x in both]).astype(np.int32) for n in (0, 1)))]
                out = pa.RecordBatch.from_arrays([batch.column(0), lists[0], pa.array(pieces.decode(ids), pa.string()), *lists[1:]], names=["doc_id", "ids", "decoded", "starts", "stops"])
                yield finish[0](out) if finish else out

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, finish[1] if finish else SPANS)
