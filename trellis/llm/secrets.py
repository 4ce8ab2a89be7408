"""Secret scans with corpus-wide ownership frequency.

A scan of each whole text gives base spans (three fixed kinds) and looser candidates (provider tokens, bearer tokens,
private keys, password parts of URLs, long mixed strings). The value of each span, base or candidate, is hashed; Spark
counts, over the whole corpus, the distinct repositories and the distinct owners that hold the hash. A value that many
owners hold is a copied example; one that few hold looks live. Live candidates are added to the base spans, which
always stay, live or not.

The count deduplicates (hash, repository, owner) before it sums, so that a value which a third of all rows hold is a few
rows for each task.

Defined results: null and empty texts have no spans; offsets are code points, end exclusive; repeated spans of one kind
count once; a candidate inside a base span or an earlier candidate is not added; null owners count as one owner; rows of
equal or null id are scanned each for itself; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.llm.common import materialise, parted

MAX_OWNERS, MAX_REPOSITORIES = 2, 3
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
# looser candidates: name, what the text must hold for the pattern to be tried, pattern with the value as group 1
CANDIDATES = (
    ("forge", "gh", re.compile(r"\b(gh[pousr]_[A-Za-z0-9]{30,})")),
    ("pay", "_live_", re.compile(r"\b([sr]k_live_[A-Za-z0-9]{16,})")),
    ("chat", "xox", re.compile(r"\b(xox[abprs]-[A-Za-z0-9-]{10,})")),
    ("jwt", "eyJ", re.compile(r"\b(eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*)")),
    ("bearer", "earer ", re.compile(r"\b[Bb]earer ([A-Za-z0-9._~+/=-]{16,})")),
    ("pem", "PRIVATE KEY-----", re.compile(r"(-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----)")),
    ("url", "://", re.compile(r"://[^\s/:@]+:([^\s/:@]{6,})@")),
    ("mixed", "", re.compile(r"(?<![A-Za-z0-9+/_-])([A-Za-z0-9+/_-]{28,})(?![A-Za-z0-9+/_-])")),
)
FOUND = "doc_id long, text_hash long, repository string, owner string, base array<struct<kind:int,start:int,stop:int>>, extra array<struct<kind:int,start:int,stop:int,hash:binary>>"
_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32())])
_EXTRA = pa.struct([*_SPAN, ("hash", pa.binary())])


def mixed(value: str) -> bool:
    """A long string that holds digits and both cases, as keys do and words don't."""
    return any(c.isdigit() for c in value) and value.lower() != value and value.upper() != value


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, stop) by start, then kind."""
    low = text.lower()
    spans = [(2, m.start(), m.end()) for m in HEX.finditer(text)]
    if "AKIA" in text:
        spans += [(1, m.start(), m.end()) for m in ACCESS.finditer(text)]
    if any(x in low for x in ("passw", "secret", "token", "apikey", "api_key")):
        spans += [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    return sorted(spans, key=lambda x: (x[1], x[0]))


def digest(value: str) -> bytes:
    return hashlib.blake2b(value.encode(), digest_size=16).digest()


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, bytes]]:
    """(kind, start, stop, hash of the value): the base spans, then what the looser patterns add."""
    out = [(kind, a, b, digest(ASSIGN.fullmatch(text, a, b)[2] if kind == 0 else text[a:b])) for kind, a, b in base]
    for kind, (name, hint, pattern) in enumerate(CANDIDATES, len(KINDS)):
        if hint in text:
            known = sorted((a, b) for _, a, b, _ in out)
            starts, furthest = [a for a, _ in known], list(accumulate((b for _, b in known), max))
            for m in pattern.finditer(text):
                before = bisect_right(starts, m.start(1))  # the spans that start no later
                if (name != "mixed" or mixed(m[1])) and not (before and furthest[before - 1] >= m.end(1)):
                    out.append((kind, m.start(1), m.end(1), digest(m[1])))
    return out


def scan(rows: DataFrame) -> DataFrame:
    """(doc_id, text_hash, repository, owner, base, extra) of every row (doc_id, text_hash, repository, owner, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, extra = [], []
            for text in batch.column("text"):
                text = text.as_py() or ""
                base.append(spans := base_spans(text))
                extra.append(candidates(text, spans))
            names = [[dict(zip(("kind", "start", "stop", "hash"), x)) for x in spans] for spans in base], [[dict(zip(("kind", "start", "stop", "hash"), x)) for x in spans] for spans in extra]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(names[0], pa.list_(_SPAN)), pa.array(names[1], pa.list_(_EXTRA))], names=["doc_id", "text_hash", "repository", "owner", "base", "extra"])

    return rows.select("doc_id", "text_hash", "repository", "owner", "text").mapInArrow(run, FOUND)


def ownership(found: DataFrame) -> DataFrame:
    """(hash, n_repositories, n_owners) over all candidates of (hash, repository, owner) rows."""
    pairs = found.select("hash", "repository", "owner").distinct()
    owners = pairs.groupBy("hash", "owner").agg(F.count("*").alias("n"))
    return owners.groupBy("hash").agg(F.sum("n").alias("n_repositories"), F.count("*").alias("n_owners"))


def owner_of(repository: Column) -> Column:
    """The owner part of a repository's name: what stands before the first slash, the whole name if there is none."""
    return F.substring_index(repository, "/", 1)


def scan_secrets(docs: DataFrame, repository: str = "source", owner: str | None = None, max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """(doc_id, text_hash, base, live): the base spans and the owner-specific spans of each row.

    ``repository`` and ``owner`` name columns; without ``owner`` it is the repository's name up to its first slash. ``live``
    entries, base spans among them, carry n_repositories and n_owners; a value is live if it is held by no more than
    ``max_owners`` owners and ``max_repositories`` repositories. ``text_hash`` (xxhash64) tells texts of one id apart.
    """
    repo = F.coalesce(F.col(repository).cast("string"), F.lit(""))
    own = F.coalesce(F.col(owner).cast("string"), F.lit("")) if owner else owner_of(repo)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), repo.alias("repository"), own.alias("owner"), "text")
    found = materialise(scan(rows).withColumn("row", F.monotonically_increasing_id()), "secrets")  # the rows' numbers are fixed once written
    single = found.filter(F.size("extra") > 0).select("row", "repository", "owner", F.explode("extra").alias("x")).select("row", "repository", "owner", "x.kind", "x.start", "x.stop", "x.hash")
    rare = ownership(single).filter((F.col("n_owners") <= max_owners) & (F.col("n_repositories") <= max_repositories))
    live = single.join(rare, "hash").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "stop", "n_repositories", "n_owners"))).alias("live"))
    none = F.array().cast("array<struct<start:int,kind:int,stop:int,n_repositories:long,n_owners:long>>")
    return found.select("row", "doc_id", "text_hash", "base").join(live, "row", "left").select("doc_id", "text_hash", "base", F.coalesce("live", none).alias("live"))


def names(kind):
    """Column of a kind's name."""
    return F.element_at(F.array(*(F.lit(x) for x in (*KINDS, *(c[0] for c in CANDIDATES)))), kind + 1)


def redact(docs: DataFrame, spans: DataFrame, mark: str = "[secret]") -> DataFrame:
    """The documents with every span (doc_id, text_hash, spans array<struct<start,stop>>) replaced by ``mark``; n_chars follows.

    Spans belong to an id and a text, so texts of one id keep their own; null ids meet null ids. Only texts whose hash may
    be among the spans are dealt out for the join. The helper columns' names avoid those of ``docs``."""
    schema = docs.schema
    hashed, cuts_of, at_id = (free_name(x, docs.columns) for x in ("text_hash", "spans", "spans_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, cuts in enumerate(batch.column(cuts_of).to_pylist()):
                if cuts:
                    at, parts = 0, []
                    for start, stop in sorted((x["start"], x["stop"]) for x in cuts):
                        if stop > at:
                            parts += [texts[i][at:start]] + ([mark] if start >= at else [])
                            at = stop
                    texts[i] = "".join((*parts, texts[i][at:]))
            columns = {f.name: batch.column(f.name) for f in schema} | {"text": pa.array(texts, pa.string())}
            yield pa.RecordBatch.from_pydict({k: columns[k] for k in schema.names})

    spans = materialise(spans.groupBy("doc_id", "text_hash").agg(F.max("spans").alias("spans")), "spans")
    away, here = parted(docs.withColumn(hashed, F.xxhash64("text")), spans.select("text_hash"), hashed, "text_hash")
    held = spans.select(F.col("doc_id").alias(at_id), F.col("text_hash").alias(hashed), F.col("spans").alias(cuts_of))
    out = here.join(held, (here[hashed] == held[hashed]) & F.col("doc_id").cast("long").eqNullSafe(F.col(at_id)), "left").select(*schema.names, cuts_of).mapInArrow(run, schema)
    if "n_chars" in schema.names:
        count = lambda df: df.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType))
        out, away = count(out), count(away)
    return away.select(*schema.names).unionByName(out)


def free_name(name: str, taken: list[str]) -> str:
    while name in taken:
        name += "_"
    return name
