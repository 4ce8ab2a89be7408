"""Quality classifier: a generalised additive model with pairwise interactions.

Each document becomes ``FEATURES`` numbers, computed from its whole text. Training bins each feature by quantiles and
boosts cyclically: every round visits the features in turn and fits a tree of up to four leaves over the feature's bins
to the gradient of the log loss, adding it at a small rate to the feature's lookup table. Then the pairs of
features with the largest gain on what is left get tables over coarser bins in the same way. A score is the
sigmoid of table entries added up, by vectorised look-ups.

The model is fitted on at most ``SAMPLE`` labelled documents (those whose ids hash least), whatever the corpus's size; it is
a few kilobytes. Scoring reads each text once and shuffles nothing.

Defined results: null and empty texts have the features of an empty text and get a score; labels other than 0 and 1, null
ids and ids without a document are left out; of several labels of a document the least counts; without labels of both
classes every score is 0.5; extra columns of documents and labels are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE, BINS, PAIR_BINS, ROUNDS, PAIRS, PAIR_ROUNDS, RATE = 20_000, 48, 12, 150, 8, 60, 0.15
THRESHOLD = 0.3
FEATURES = (
    "log_words", "word_length", "unique_words", "unique_pairs", "same_as_before", "top_word", "word_entropy", "long_words", "short_words", "letters", "upper", "digits", "marks", "symbols",
    "symbol_ends", "bare_symbols", "stops", "line_words", "repeated_lines", "capital_words", "longest_run", "wide_letters",
)
_LETTER_UPPER, _LETTER_LOWER, _DIGIT, _MARK, _SYMBOL, _SPACE = 1, 2, 3, 4, 5, 6
_CLASS = np.full(256, 7, dtype=np.uint8)  # 7: bytes of characters beyond ASCII
for _byte in range(128):
    _c = chr(_byte)
    _CLASS[_byte] = _LETTER_UPPER if _c.isupper() else _LETTER_LOWER if _c.islower() else _DIGIT if _c.isdigit() else _MARK if _c in ".,;:?'\"()-" else _SPACE if _c.isspace() or _byte < 32 else _SYMBOL
_SYMBOLS = tuple("!#$%&*|@^~<>=+_/\\{}[]")


def features(text: str) -> list[float]:
    """The features of one whole text, in the order of ``FEATURES``."""
    data = text.encode()
    n = max(1, len(data))
    counts = np.bincount(_CLASS[np.frombuffer(data, dtype=np.uint8)], minlength=8)
    letters = int(counts[_LETTER_UPPER] + counts[_LETTER_LOWER])
    words = text.split()
    m = max(1, len(words))
    seen = Counter(words)
    lines = text.split("\n")
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) if words else np.zeros(1, dtype=np.int64)
    share = np.fromiter(seen.values(), dtype=np.float64, count=len(seen)) / m if seen else np.ones(1)
    longest = run = 0
    same = 0
    before = None
    for word in words:
        run = run + 1 if word == before else 1
        same += run > 1
        longest = max(longest, run)
        before = word
    return [
        math.log1p(len(words)), float(lengths.mean()), len(seen) / m, len(set(zip(words, words[1:]))) / max(1, m - 1), same / m, float(share.max()), float(-(share * np.log(share)).sum()) / math.log(m + 1),
        float((lengths > 12).mean()), float((lengths <= 3).mean()), letters / n, counts[_LETTER_UPPER] / max(1, letters), counts[_DIGIT] / n, counts[_MARK] / n, counts[_SYMBOL] / n,
        sum(w.endswith(_SYMBOLS) for w in words) / m, sum(w in _SYMBOLS for w in words) / m, (text.count(".") + text.count("?")) / m, m / len(lines), 1 - len(set(lines)) / len(lines),
        sum(w[0].isupper() for w in words) / m, math.log1p(longest), counts[7] / n,
    ]


@dataclass
class Model:
    """Lookup tables: cuts and values of each feature, and (i, j, values) of each pair over the coarser cuts."""

    bias: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_cuts: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for f, (cuts, table) in enumerate(zip(self.cuts, self.tables)):
            total += table[np.searchsorted(cuts, x[:, f], "right")]
        coarse = {f: np.searchsorted(self.pair_cuts[f], x[:, f], "right") for i, j, _ in self.pairs for f in (i, j)}
        for i, j, table in self.pairs:
            total += table[coarse[i], coarse[j]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def quantile_cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], method="nearest"))


def shallow_tree(gradient: np.ndarray, weight: np.ndarray, leaves: int = 4, ridge: float = 2.0) -> np.ndarray:
    """Values by bin of the tree with at most ``leaves`` leaves that best fits -gradient / weight."""
    g, h = (np.concatenate(([0.0], np.cumsum(x))) for x in (gradient, weight))
    worth = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + ridge)
    parts = [(0, len(gradient))]
    while len(parts) < leaves:
        best = (1e-9, 0, 0)
        for k, (a, b) in enumerate(parts):
            if b - a > 1:
                at = np.arange(a + 1, b)
                gain = worth(a, at) + worth(at, b) - worth(a, b)
                c = int(gain.argmax())
                best = max(best, (float(gain[c]), k, int(at[c])))
        if not best[2]:
            break
        a, b = parts.pop(best[1])
        parts += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(gradient))
    for a, b in parts:
        out[a:b] = -(g[b] - g[a]) / (h[b] - h[a] + ridge)
    return out


def quarter(gradient: np.ndarray, weight: np.ndarray, ridge: float = 2.0) -> tuple[float, np.ndarray]:
    """Gain and values of the best two-way cut of a grid into four leaves."""
    g, h = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (gradient, weight))
    leaf = lambda s, r0, r1, c0, c1: s[r1, c1] - s[r0, c1] - s[r1, c0] + s[r0, c0]
    rows, columns = np.meshgrid(np.arange(1, len(gradient)), np.arange(1, gradient.shape[1]), indexing="ij")
    if not rows.size:
        return 0.0, np.zeros(gradient.shape)
    zero, r, c = np.zeros_like(rows), np.full_like(rows, len(gradient)), np.full_like(rows, gradient.shape[1])
    boxes = [(zero, rows, zero, columns), (zero, rows, columns, c), (rows, r, zero, columns), (rows, r, columns, c)]
    worth = sum(leaf(g, *b) ** 2 / (leaf(h, *b) + ridge) for b in boxes)
    at = np.unravel_index(worth.argmax(), worth.shape)
    out = np.zeros(gradient.shape)
    for b in boxes:
        r0, r1, c0, c1 = (int(x[at]) for x in b)
        out[r0:r1, c0:c1] = -leaf(g, r0, r1, c0, c1) / (leaf(h, r0, r1, c0, c1) + ridge)
    return float(worth.max()), out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    if not len(y) or y.min() == y.max():
        return Model()
    rate = y.mean()
    model = Model(bias=math.log(rate / (1 - rate)), cuts=[quantile_cuts(c, BINS) for c in x.T], pair_cuts=[quantile_cuts(c, PAIR_BINS) for c in x.T])
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    bins = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(model.cuts)]
    total = np.full(len(y), model.bias)

    def slope() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        return p - y, p * (1 - p)

    for _ in range(ROUNDS):
        for f, b in enumerate(bins):
            g, h = slope()
            step = RATE * shallow_tree(*(np.bincount(b, s, len(model.tables[f])) for s in (g, h)))
            model.tables[f] += step
            total += step[b]
    coarse = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(model.pair_cuts)]
    wide = [len(c) + 1 for c in model.pair_cuts]
    grid = lambda i, j, s: np.bincount(coarse[i] * wide[j] + coarse[j], s, wide[i] * wide[j]).reshape(wide[i], wide[j])
    g, h = slope()
    found = [(quarter(grid(i, j, g), grid(i, j, h))[0], i, j) for i in range(x.shape[1]) for j in range(i)]
    chosen = [(i, j, np.zeros((wide[i], wide[j]))) for _, i, j in sorted(found, reverse=True)[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for i, j, values in chosen:
            g, h = slope()
            step = RATE * quarter(grid(i, j, g), grid(i, j, h))[1]
            values += step
            total += step[coarse[i], coarse[j]]
    model.pairs = chosen
    return model


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def features_of(docs: DataFrame, extra: str) -> DataFrame:
    """(doc_id, <extra>, x array<double>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column(extra), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", extra, "x"])

    return docs.select("doc_id", extra, "text").mapInArrow(run, f"doc_id long, {extra} int, x array<double>")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on up to ``sample`` labelled documents outside the held-out fold."""
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("doc_id is not null and quality in (0, 1)").filter(~held_out(F.col("doc_id")))
    chosen = chosen.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = features_of(docs.join(F.broadcast(chosen), "doc_id"), "quality").orderBy("doc_id").limit(sample).collect()  # both bounded by ``sample``
    if not rows:
        return Model()
    return fit(np.array([r.x for r in rows]), np.array([r.quality for r in rows], dtype=np.float64))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t or "") for t in batch.column(1).to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with all their columns, that score ``threshold`` or more; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t or "") for t in batch.column("text").to_pylist()]).reshape(-1, len(FEATURES))
            yield batch.filter(pa.array(model.score(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)
