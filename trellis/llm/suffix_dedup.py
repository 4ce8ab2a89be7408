"""Byte-level removal of repeated spans.

Removes every byte that lies in a ``window``-byte string which also starts anywhere else in the corpus, be it in
the same text. The repeated windows come from ``repeats.py`` (minimiser paths, exact); ``bwt.py`` has the merging of
shard Burrows-Wheeler transforms that gives the same windows for collections of a size that one task can hold. The
README says why the corpus-wide query doesn't use it, with figures.

Defined results: null and empty texts have no bytes; texts under ``window`` bytes lose nothing; windows never cross
texts; a text in several rows loses all its windows in every row, be the ids equal, null or
neither; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from trellis.llm import repeats

WINDOW, GRAM = 200, 100
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def dedup_bytes(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): each text's bytes without the repeated windows."""
    docs = repeats.keyed(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, lists = batch.columns
            total, removed, spans, kept = [], [], [], []
            for text, runs in zip(texts, lists):
                data = (text.as_py() or "").encode()
                total.append(len(data))
                gone = np.zeros(len(data), dtype=bool)
                if runs.is_valid:
                    flat = runs.values
                    gone = repeats.covered(flat.field("start").to_numpy(), flat.field("n").to_numpy(), window, len(data))
                    data = np.frombuffer(data, dtype=np.uint8)[~gone].tobytes()
                removed.append(int(gone.sum()))
                spans.append(int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum()))
                kept.append(data)
            columns = [pa.array(x, pa.int64()) for x in (total, removed, spans)]
            yield pa.RecordBatch.from_arrays([ids, *columns, pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return repeats.with_runs(docs, repeats.repeated(docs, "byte", window, gram)).mapInArrow(run, SCHEMA)
