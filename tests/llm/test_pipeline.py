import random

import corpus_pipeline
import sentencepiece
from test_ngram_join import brute as near
from test_decontamination import brute as leaks
from test_secrets import brute as spans
from trellis.llm import pieces, quality, queries


def test_stages_against_brute_force(spark, tmp_path):
    rng = random.Random(6)
    words = lambda n: ["".join(rng.choices("etaoinshr", k=rng.randrange(1, 9))) for _ in range(n)]
    bench = [(i, " ".join(words(25))) for i in range(5)]
    rows, labels = [], []
    for d in range(300):
        text = words(rng.randrange(30, 90))
        bad = d % 5 == 0
        if bad:
            text = [w.upper() + "!!" for w in text]
        elif d % 7 == 1:
            text[3:3] = bench[d % 5][1].split()
        elif d % 7 == 2:
            text[3:3] = ["token", "=", f"'abcdef{d}'"]
        elif d % 7 == 3 and len(rows) > 9:
            text = (rows[-2][1] or "x").split()
            text[rng.randrange(len(text))] = "edit"
        rows.append((d, " ".join(text), "en", f"src{d % 3}"))
        labels.append((d, int(not bad), 0))
    rows += [(300, None, "en", None), (301, "", "en", "src1")]
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    score = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    kept = [r for r in rows if score[r[0]] >= 0.3]
    assert not any(d % 5 == 0 for d, *_ in kept if d < 300) and len(kept) > 200
    component = near([r[:2] for r in kept], 5, 4, 5)
    kept = [r for r in kept if component[r[0]][1] == r[0]]
    gone = {x[0] for x in leaks([r[:2] for r in kept], bench, 5, 4, 5)}
    assert len(gone) > 10
    kept = [r for r in kept if r[0] not in gone]
    library = sentencepiece.SentencePieceProcessor(model_proto=queries.piece_model())
    want = {}
    for d, text, *_ in kept:
        for _, a, b in reversed(spans(text)):
            text = text[:a] + "[secret]" + text[b:]
        want[d] = library.encode(text or "", add_bos=True, add_eos=True)
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want
    assert len(corpus_pipeline.STAGES) == 5 and pieces and docs.columns == corpus_pipeline.without_secrets(spark, docs, str(tmp_path)).columns
