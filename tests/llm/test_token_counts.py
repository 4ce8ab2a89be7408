import random
from pathlib import Path

import public_tokenizers
from tokenizers import Tokenizer, models

from trellis.llm import pieces, token_counts

MODEL = Path(public_tokenizers.path("piece_bpe_32k.model")).read_bytes()


def reference():
    """The library's unigram model over the same vocabulary; pieces that are not ordinary get names that no text has."""
    p = pieces.loaded(MODEL)
    vocabulary = [(t.decode() if k in (1, 4, 6) else f"\U0010fffe{i}", s if k in (1, 4) else 0.0) for i, (t, s, k) in enumerate(zip(p.texts, p.scores, p.kinds))]
    low = min(s for _, s in vocabulary)
    assert low <= 0
    return Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=True))


def test_as_the_library(spark):
    library = reference()
    rng = random.Random(3)
    texts = ["a", "Hello world", "  two  spaces ", "line\nend\n\n", "naïve café 日本語 😀\x00", "▁ ▁x", "the" * 300, " ", "\n", "\t\t a　b"]
    letters = "theanioрж é▁ \n.,"
    texts += ["".join(rng.choices(letters, k=rng.randrange(1, 60))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate([None, "", *texts])], "doc_id int, text string, n_tokens int").repartition(3)
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(df, MODEL).collect()}
    assert (got[0], got[1]) == (0, 0)
    for i, text in enumerate(texts, 2):
        assert got[i] == len(library.encode("▁" + text.replace(" ", "▁"), add_special_tokens=False).ids), text


def test_empty_table(spark):
    assert token_counts.count_tokens(spark.createDataFrame([], "doc_id long, text string"), MODEL).count() == 0
