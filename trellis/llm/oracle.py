"""The same results in DuckDB SQL, for the queries that SQL can express."""

from __future__ import annotations

_WORDS = r"[^\x20\x09-\x0D]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _shingles(name: str, table: str, key: str, n: int, whole: bool) -> str:
    """(key, s): distinct n-word shingles; with ``whole`` fewer words make one."""
    rows = f"SELECT {key}, regexp_extract_all({_LOWER}, '{_WORDS}') AS w FROM {table}"
    short = f" UNION ALL SELECT {key}, array_to_string(w, ' ') FROM {name}_w WHERE len(w) BETWEEN 1 AND {n - 1}" if whole else ""
    return f"""{name}_w AS ({rows}), {name} AS (SELECT DISTINCT {key}, s FROM (SELECT {key}, array_to_string(w[p + 1:p + {n}], ' ') AS s FROM (SELECT {key}, w, unnest(range(len(w) - {n - 1})) AS p FROM {name}_w WHERE len(w) >= {n}){short}))"""


DECONTAMINATION = f"""WITH {_shingles('d', 'documents', 'doc_id', 5, False)}, {_shingles('b', 'benchmark', 'item_id', 5, False)},
n AS (SELECT item_id, count(*) AS n_item FROM b GROUP BY item_id), h AS (SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN b USING (s) GROUP BY ALL)
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(item_id AS BIGINT) AS item_id, n_shared, n_item FROM h JOIN n USING (item_id) WHERE n_shared * 5 >= n_item * 4"""

TOPK = """WITH v AS (SELECT CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q, v c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20"""

SUBSTRING = f"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents),
win AS (SELECT doc_id, p, array_to_string(w[p + 1:p + 50], ' ') AS k FROM (SELECT doc_id, w, unnest(range(len(w) - 49)) AS p FROM d WHERE len(w) >= 50)),
f AS (SELECT k, min(doc_id) AS first FROM win GROUP BY k), gone AS (SELECT DISTINCT doc_id, p + o AS i FROM win JOIN f USING (k), range(50) r(o) WHERE first < doc_id),
tok AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS i FROM d), kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS s, count(*) AS n FROM tok ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT CAST(d.doc_id AS BIGINT) AS doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

NGRAM_JOIN = f"""WITH RECURSIVE {_shingles('d', 'documents', 'doc_id', 3, True)}, n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM d a JOIN d b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM i JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 90 * (p.n + q.n - c)), e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, c) AS (SELECT x, x FROM e UNION SELECT y, c FROM r JOIN e ON x = r.doc_id)
SELECT CAST(t.doc_id AS BIGINT) AS doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CAST(coalesce((SELECT min(c) FROM r WHERE r.doc_id = t.doc_id), t.doc_id) AS BIGINT) AS component_id FROM documents t LEFT JOIN n USING (doc_id)"""

ORACLE_SQL = {"op2_decontamination": DECONTAMINATION, "op5_topk_search": TOPK, "op6_substring_dedup": SUBSTRING, "op8_ngram_join": NGRAM_JOIN}
