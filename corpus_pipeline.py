"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again for the next one.
All but the last return the columns of ``documents``:

1. quality: documents that the classifier rejects go; empty and null texts are scored like others.
2. near_duplicates: of documents linked by similar 5-word shingle sets (Jaccard 0.8 or more) the least id stays;
   documents without words and rows of a null doc_id are linked with nothing and stay.
3. decontamination: documents that hold 0.8 or more of a benchmark item's 5-word shingles go.
4. secrets: spans of secrets, base and live, become ``[secret]``; n_chars follows; no document goes.
5. pieces: the ids of every whole text, begin and end ids included, and a digest of the decoded text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.llm import decontamination, ngram_join, pieces, quality, queries, secrets
from trellis.llm.common import materialise, parted, ship, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    joined = ngram_join.jaccard_join(docs, n=5, num=4, den=5)
    copies = materialise(joined.filter("doc_id <> component_id").select("doc_id"), "copies")
    alone, rest = parted(docs, copies)  # texts that are surely no copies stay where they are
    return alone.unionByName(rest.join(copies, rest["doc_id"].cast("long") == copies["doc_id"], "left_anti"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    span = lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"))
    found = secrets.scan_secrets(docs).select("doc_id", "text_hash", F.concat(F.transform("base", span), F.transform("live", span)).alias("spans"))
    return secrets.redact(docs, found.filter(F.size("spans") > 0))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    out = pieces.encode_decode(docs, queries.piece_model())
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("quality", good_quality), ("near_duplicates", without_near_duplicates), ("decontamination", without_benchmark), ("secrets", without_secrets), ("pieces", encoded)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
