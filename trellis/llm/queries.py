"""The registered queries of this subpackage: thin digests of the operators' results."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.llm import decontamination, html_extraction, ngram_join, pieces, quality, secrets, substring_dedup, suffix_dedup, token_counts, topk
from trellis.llm.common import ship, table
from trellis.llm.oracle import ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]


def piece_model(name: str = "piece_bpe_32k.model") -> bytes:
    """The content of a public vocabulary file on the driver."""
    import public_tokenizers

    return Path(public_tokenizers.path(name)).read_bytes()


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), piece_model())


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return html_extraction.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), topk.quantised(F.col("embedding")).alias("vector")).filter("vector is not null")
    return topk.top_k(rows.filter("vec_id % 20 = 0"), rows, 20)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    out = substring_dedup.dedup_words(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def piece_digest(batch: pa.RecordBatch) -> pa.RecordBatch:
    ids, decoded = batch.column("ids"), batch.column("decoded").to_pylist()
    ends, flat = np.asarray(ids.offsets), ids.values.to_numpy().astype("<u4")
    starts, stops = (np.asarray(batch.column(c).values) for c in ("starts", "stops"))
    spans = np.stack((starts, stops), axis=1).astype("<u4")
    sums = np.concatenate(([0], np.cumsum(stops.astype(np.int64) - starts)))
    columns = {
        "doc_id": batch.column("doc_id"),
        "n_tokens": pa.array(np.diff(ends).astype(np.int64)),
        "ids_sha256": pa.array([hashlib.sha256(flat[a:b].tobytes()).hexdigest() for a, b in zip(ends, ends[1:])]),
        "decoded_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded]),
        "n_span_bytes": pa.array(sums[ends[1:]] - sums[ends[:-1]]),
        "spans_sha256": pa.array([hashlib.sha256(spans[a:b].tobytes()).hexdigest() for a, b in zip(ends, ends[1:])]),
    }
    return pa.RecordBatch.from_pydict(columns)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return pieces.encode_decode(table(spark, sf_dir, "documents"), piece_model(), (piece_digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_span_bytes long, spans_sha256 string"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return ngram_join.jaccard_join(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    out = suffix_dedup.dedup_bytes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", secrets.names(x["kind"]), x["start"], x["stop"])), ",")
    plain = lambda spans: F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["stop"].alias("stop")))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        joined(F.array_sort(F.array_union(plain(F.col("base")), plain(F.col("live"))))).alias("spans"), F.size("live").cast("long").alias("n_live"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_token_counts, op2_decontamination, op3_quality, op4_html_extraction, op5_topk_search, op6_substring_dedup, op7_sentencepiece, op8_ngram_join, op9_suffix_dedup, op10_secret_scan)}
