import sys
from pathlib import Path

import public_tokenizers

sys.path.insert(0, str(Path(__file__).parent))
import corpus_pipeline
from brute import near, repeats
from geoloom.llm import packing, toxicity

SMALL = "/root/testdata/sf0.001"


def test_pipeline_equals_brute_force_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    texts = {r.doc_id: r.text for r in toxicity.score(docs, model).collect() if r.score < corpus_pipeline.TOXIC}
    last = {}
    for i in sorted(texts):
        last[texts[i] or ""] = i
    texts = {i: texts[i] for i in last.values()}
    texts = {i: texts[i] for i, (_, c) in near(texts).items() if i == c}
    cut = {i: texts[i] if n == len(left) else " ".join(left) for i, (n, left) in repeats(texts).items()}
    model = packing.encoder(public_tokenizers.path("word_bpe_49k.json")).model
    want = {i: len(model.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in cut.items()}
    got, filled = {}, {}
    for r in corpus_pipeline.run(spark, SMALL).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
        filled[r.sequence_id] = filled.get(r.sequence_id, 0) + r.length
    assert got == want and max(filled.values()) <= 2048


def test_filters_keep_rows_without_an_id(spark):
    rows = [(None, "a b c", "en", "s", 5), (1, "a b c", "en", "s", 5), (2, "a b c", "en", "s", 5), (2, "a b c", "en", "s", 5), (3, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for stage in (corpus_pipeline.drop_exact_copies, corpus_pipeline.drop_near_copies, corpus_pipeline.cut_repeats):
        docs = stage(spark, docs, SMALL)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert sorted(r.doc_id or -1 for r in docs.collect()) == [-1, 2, 3]


def test_rows_that_share_an_id_are_judged_each(spark):
    long = lambda k: " ".join(f"{k}{i}" for i in range(80))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    frame = lambda rows: spark.createDataFrame([(i, t, "en", "s", 5) for i, t in rows], schema)
    read = lambda df: sorted((r.doc_id, r.text) for r in df.collect())
    a, b, c = long("a"), long("b"), long("c")
    # a copy whose id also has another text; a copy of it has a larger id
    exact = frame([(1, a), (1, b), (2, a)])
    assert read(corpus_pipeline.drop_exact_copies(spark, exact, SMALL)) == [(1, b), (2, a)]
    # id 2: a short text and a near copy; id 3: a near copy, shorter than the clean text beside it
    near_b = b.rsplit(" ", 2)[0]
    near = frame([(1, a), (1, b), (2, "x"), (2, a + " more"), (3, near_b), (3, c)])
    assert read(corpus_pipeline.drop_near_copies(spark, near, SMALL)) == sorted([(1, a), (1, b), (2, "x"), (3, c)])
    # id 2: the longer row repeats a passage
    cut = frame([(1, a), (2, b), (2, c + " " + a)])
    assert read(corpus_pipeline.cut_repeats(spark, cut, SMALL)) == sorted([(1, a), (2, b), (2, c)])


def test_stages_on_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        assert out.count() == 0, name
        if name != "packing":
            assert out.columns == docs.columns and out.schema == docs.schema
