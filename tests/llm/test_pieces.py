import struct

import numpy as np
import public_tokenizers
import sentencepiece

from trellis.llm import pieces

MODEL = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()
TEXTS = [None, "", " ", "a", "Hello  world\n\tx ", "naïve ▁ 😀 \x00 é́", "   lead", "trail   ", "日本語 テキスト", "a" * 5000, " ﬁ"]


def test_as_the_library_with_spans(spark):
    library = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id int, text string, ids string")
    for r in pieces.encode_decode(df, MODEL).collect():
        text = TEXTS[r.doc_id] or ""
        assert r.ids == library.encode(text, add_bos=True, add_eos=True)
        assert r.decoded == library.decode(r.ids)
        source = text.encode()
        spans = list(zip(r.starts, r.stops))
        assert all(a <= b for a, b in spans) and [a for a, _ in spans] == sorted(a for a, _ in spans)
        assert b"".join(source[a:b] for a, b in spans) == source
        for (a, b), i in zip(spans, r.ids):
            piece = library.id_to_piece(i).replace("▁", " ")
            if library.is_byte(i):
                assert source[a:b] == bytes([int(piece[3:5], 16)])
            elif not library.is_control(i) and b"\xe2\x96\x81" not in source:
                assert source[a:b] == piece.encode() or (a == 0 and source[a:b] == piece[1:].encode())


def test_empty_table(spark):
    assert pieces.encode_decode(spark.createDataFrame([], "doc_id long, text string"), MODEL).count() == 0


def compiled(rules):
    """A character map with a double-array trie, built naively."""
    strings, at = b"", {}
    for key, value in rules.items():
        at[key] = len(strings)
        strings += value + b"\0"
    units, used = {0: 0}, {0}

    def place(node, prefix):
        kids = sorted({k[len(prefix)] for k in rules if k.startswith(prefix) and len(k) > len(prefix)})
        leaf = prefix in rules
        base = 1
        while any((node ^ base ^ c) in used for c in kids) or (leaf and (node ^ base) in used) or (node ^ base) == 0:
            base += 1
        units[node] |= base << 10 | leaf << 8
        if leaf:
            used.add(node ^ base)
            units[node ^ base] = 0x80000000 | at[prefix]
        for c in kids:
            used.add(node ^ base ^ c)
            units[node ^ base ^ c] = c
        for c in kids:
            place(node ^ base ^ c, prefix + bytes([c]))

    place(0, b"")
    array = np.zeros(-(-(max(units) + 300) // 256) * 256, dtype="<u4")  # the library reads blocks of 1024 bytes
    for i, u in units.items():
        array[i] = u
    blob = array.tobytes()
    return struct.pack("<I", len(blob)) + blob + strings


def test_longest_prefix_and_alignment():
    rules = {"ﬁ".encode(): b"fi", b"A": b"a", b"AB": b"xyz", "　".encode(): b" ", b"~": b""}
    model = pieces.Pieces(MODEL)
    model.map = pieces.CharacterMap(compiled(rules))
    model.trim = True
    normal, at = model.normalise("  ABA ﬁ~　 é ".encode())
    assert normal.decode() == "▁xyza▁fi▁é"
    source = "  ABA ﬁ~　 é ".encode()
    assert at.tolist() == [2, 2, 2, 2, 2, 2, 4, 5, 5, 5, 6, 6, 10, 10, 10, 14, 14, 16]
    assert source[14:16].decode() == "é"


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(number, value):
    return varint(number << 3) + varint(value) if isinstance(value, int) else varint(number << 3 | 2) + varint(len(value)) + value


def with_map(blob):
    """The public model with a compiled character map and removal of extra white space."""
    parts = [(n, v) for n, v in pieces.fields(MODEL) if n != 3 and isinstance(v, bytes)]
    return b"".join(field(n, v) for n, v in parts) + field(3, field(1, b"own") + field(2, blob) + field(3, 1) + field(4, 1) + field(5, 1))


def test_a_model_with_a_compiled_map(spark):
    rules = {"ﬁ".encode(): b"fi", b"A": b"a", b"AB": b"xyz", "　".encode(): b" ", "é".encode(): "e".encode(), "ｗ".encode(): b"w"}
    model = with_map(compiled(rules))
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    texts = [None, "", "  ABA ﬁnd　 é ", "AB ABAB AAB", "ﬁﬁ  ｗord", "plain  text", "日本 é　", "A"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "é A", "x"), (3, "other AB", "x")], "doc_id int, text string, starts string")
    seen = 0
    for r in pieces.encode_decode(df, model).collect():
        text = texts[r.doc_id] or "" if r.doc_id is not None and list(r.ids) == library.encode(texts[r.doc_id] or "", add_bos=True, add_eos=True) else "é A" if r.doc_id is None else "other AB"
        assert list(r.ids) == library.encode(text, add_bos=True, add_eos=True) and r.decoded == library.decode(list(r.ids))
        own = pieces.Pieces(model)
        spelled = b"".join(own.texts[i] if own.kinds[i] == 1 else bytes([int(own.texts[i][3:5], 16)]) if own.kinds[i] == 6 else b"" for i in r.ids)
        assert spelled == own.normalise(text.encode())[0]
        source = text.encode()
        for start, stop, i in zip(r.starts, r.stops, r.ids):
            if own.kinds[i] == 1 and stop > start:
                part = own.normalise(source[start:stop])[0].replace(pieces.ESCAPE, b"")
                assert own.texts[i].replace(pieces.ESCAPE, b"") in part
                seen += 1
    assert seen > 20
