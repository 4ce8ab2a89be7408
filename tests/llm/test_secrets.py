import random
import re

from pyspark.sql import functions as F
from trellis.llm import secrets


def brute(text):
    a = [(0, m.start(), m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text or "", re.I | re.A) if len(m[2]) >= 6]
    b = [(1, m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text or "") if m.end() - m.start() >= 20]
    c = [(2, m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text or "") if m.end() - m.start() >= 24]
    return sorted(a + b + c, key=lambda x: (x[1], x[0]))


ROWS = [
    (0, None, "a"), (1, "", "a"), (2, "é API_KEY = 'abcDEF12' x", "a"), (3, "token=token: abcdefgh secret:\t1234567 PassWord  :  xyzzyx", "b"), (4, "AKIAAKIA" + "B" * 15 + " AKIAshort AKIA" + "9" * 16, None),
    (5, "0" * 23 + " " + "a1" * 12 + " token=" + "f" * 40, "c"), (6, "ghp_" + "Ab1" * 12, "a"), (7, "ghp_" + "Ab1" * 12, "a"), (8, "x\nBearer Zz9Zz9Zz9Zz9Zz9Zz9 y", "a"),
] + [(20 + i, "copied gho_" + "Qw3" * 11 + " and passwd=hunter22", f"s{i}") for i in range(6)]


def test_base_and_live_spans(spark):
    df = spark.createDataFrame([(*r, 1) for r in ROWS], "doc_id long, text string, source string, hash int").repartition(3)
    got = {r.doc_id: r for r in secrets.scan_secrets(df).collect()}
    assert set(got) == {r[0] for r in ROWS}
    for i, text, _ in ROWS:
        assert [tuple(x) for x in got[i].base] == brute(text)
    assert [(x.kind, x.start, x.stop, x.n_owners) for x in got[6].live] == [(3, 0, 40, 1)]
    assert [(x.start, x.stop) for x in got[8].live] == [(9, 27)]
    assert not got[20].live and got[20].base  # six owners hold both values: examples
    assert [x.n_owners for x in got[2].live] == [1]


def test_redact(spark):
    df = spark.createDataFrame([(1, "a token=abcdefg b", 17), (2, None, 0)], "doc_id long, text string, n_chars long")
    found = secrets.scan_secrets(df.selectExpr("*", "'s' source")).selectExpr("doc_id", "text_hash", "transform(base, x -> struct(x.start, x.stop)) spans")
    assert sorted(map(tuple, secrets.redact(df, found).collect())) == [(1, "a [secret] b", 12), (2, None, None)]


def test_empty_table(spark):
    assert secrets.scan_secrets(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_capitals_inside_the_keyword_only(spark):
    texts = ["passWord: hunter22", "toKEN=abcdef1", "sEcret: 1234567", "apI_key: abcdef1", "paSswd=hunter22"]
    df = spark.createDataFrame([(i, t, "a") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    assert {r.doc_id: [tuple(x) for x in r.base] for r in secrets.scan_secrets(df).collect()} == {i: [(0, 0, len(t))] for i, t in enumerate(texts)}


def test_every_case_of_the_keywords():
    rng = random.Random(2)
    for word in ("password", "passwd", "secret", "token", "apikey", "api_key"):
        for _ in range(60):
            mixed = "".join(rng.choice((c, c.upper())) for c in word)
            text = f"{rng.choice(('', 'é ', 'x'))}{mixed}{rng.choice(('=', ': ', chr(34) + ' = '))}{rng.choice(('hunter22', 'abcde', 'Zz9_.-+/='))}"
            assert secrets.base_spans(text) == brute(text)


def live_brute(rows):
    """Live spans by plain counting: rows (doc_id, text, repository, owner)."""
    found, held = [], {}
    for _, text, repository, owner in rows:
        spans = [(k, a, b, re.fullmatch(r"""\w+?["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text[a:b])[1] if k == 0 else text[a:b]) for k, a, b in brute(text)]
        for k, (name, hint, pattern) in enumerate(secrets.CANDIDATES, 3):
            for m in pattern.finditer(text or ""):
                value = m[1]
                if name == "mixed" and not (re.search(r"\d", value) and re.search("[a-z]", value) and re.search("[A-Z]", value)):
                    continue
                if not any(a <= m.start(1) and m.end(1) <= b for _, a, b, _ in spans):
                    spans.append((k, m.start(1), m.end(1), value))
        found.append(spans)
        for *_, value in spans:
            held.setdefault(value, set()).add((repository, owner))
    few = {v for v, who in held.items() if len({o for _, o in who}) <= secrets.MAX_OWNERS and len(who) <= secrets.MAX_REPOSITORIES}
    return [sorted((a, k, b) for k, a, b, v in spans if v in few) for spans in found]


def test_live_spans_by_plain_counting(spark):
    rng = random.Random(3)
    values = ["ghp_" + "Ab1" * 11, "sk_live_" + "9aZ" * 7, "xoxb-12345678901-ab", "Aa0" * 12, "0123456789abcdef" * 2, "AKIA" + "Z" * 16, "tok.en-value"]
    forms = ["token={}", "Bearer {}", "https://u:{}@h/x", " {} ", "é {} {}"]
    rows = []
    for i in range(120):
        text = " and ".join(rng.choice(forms).replace("{}", rng.choice(values) + ("" if rng.random() < 0.6 else str(rng.randrange(40)))) for _ in range(rng.randrange(4)))
        rows.append((i, text, f"o{rng.randrange(3)}/r{rng.randrange(5)}"))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    want = live_brute([(i, t, s, s.split("/")[0]) for i, t, s in rows])
    got = {r.doc_id: [(x.start, x.kind, x.stop) for x in r.live] for r in secrets.scan_secrets(df).collect()}
    assert got == dict(enumerate(want)) and any(want) and len({len(x) for x in want}) > 2


def test_repeated_and_null_ids_and_long_texts(spark):
    long = " ".join(f"token=abc{i:06d}" for i in range(20_000))
    rows = [(1, "token=abcdefg x", 15, "s"), (1, "plain text here", 15, "s"), (1, "token=abcdefg x", 15, "s"), (None, "secret=abcdefg", 14, None), (None, None, 0, None), (2, long, len(long), "s")]
    df = spark.createDataFrame(rows, "doc_id int, text string, n_chars int, spans string").withColumn("source", F.lit("a/b"))
    found = secrets.scan_secrets(df)
    assert sorted((len(r.base), len(r.live)) for r in found.collect()) == [(0, 0), (0, 0), (1, 1), (1, 1), (1, 1), (20_000, 20_000)]
    out = secrets.redact(df, found.selectExpr("doc_id", "text_hash", "transform(base, x -> struct(x.start, x.stop)) spans"))
    assert out.columns == df.columns
    kept = sorted((r.doc_id or 0, r.text if r.text is None or len(r.text) < 99 else r.text[:17], r.n_chars if r.text else None) for r in out.collect() if r.text is not None)
    assert kept == [(0, "[secret]", 8), (1, "[secret] x", 10), (1, "[secret] x", 10), (1, "plain text here", 15), (2, "[secret] [secret]", 20_000 * 9 - 1)]
