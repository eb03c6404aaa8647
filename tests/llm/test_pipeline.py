"""The whole pipeline against brute force, given the verdicts of the learned rules."""

import re

from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm import brute
from tidemark.llm import ngram_join, quality_rules
from tidemark.llm.queries import tokenizer_path


def test_pipeline(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    stays = {r.doc_id for r in quality_rules.quality_rules(docs, labels).where("kept").collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in stays]
    assert 0.6 * docs.count() < len(rows) < docs.count()
    exact = brute.exact(rows)
    rows = [(d, t) for d, t in rows if exact[d][2]]
    near = brute.near(rows)
    rows = [(d, t) for d, t in rows if near[d][1] == d]
    cut = brute.substrings(rows)
    rows = [(d, cut[d][3] if cut[d][1] else t) for d, t in rows]
    result = corpus_pipeline.run(spark, small).collect()
    bins, tokens = brute.packed(rows, Tokenizer.from_file(tokenizer_path("word_bpe_49k.json")), result)
    assert bins <= -(-tokens // 2048) + 2


def test_stages_keep_the_columns(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "ngram_join", "substring_dedup", "best_fit_packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, small).dtypes == docs.dtypes
    out = corpus_pipeline.substrings(spark, docs, small)
    assert out.where("n_chars <> length(text)").count() == 0 and out.count() == docs.count()
    assert re.fullmatch(r"doc_id.*", docs.columns[0])


def test_repeated_rows(spark, small):
    """Rows of a document that was loaded twice or more become one; a doc_id with two texts keeps both, each cut alone."""
    words = [f"w{i}" for i in range(200)]
    passage = " ".join(words[:40])
    first, second, other = passage + " one", " ".join(words[60:90]) + " " + passage, " ".join(words[100:160])
    rows = [(1, first), (2, second), (2, second), (2, second), (3, other), (3, other), (4, first), (4, "new " + " ".join(words[160:])), (5, other + " "), (5, other)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = corpus_pipeline.exact(spark, docs, small)
    assert sorted((r.doc_id, r.text) for r in got.collect()) == [(1, first), (2, second), (4, rows[7][1]), (5, other + " ")]
    got = corpus_pipeline.near(spark, got, small)
    assert sorted(r.doc_id for r in got.collect()) == [1, 2, 4, 5]
    rest = " ".join(words[60:90])
    again = docs.sparkSession.createDataFrame([(d, t, "en", None, 0) for d, t in [(1, first), (2, second), (2, second), (2, other), (6, None)]], docs.schema)
    got = sorted((r.doc_id, r.text or "", r.n_chars) for r in corpus_pipeline.substrings(spark, again, small).collect())
    assert got == [(1, first, 0), (2, other, 0), (2, rest, len(rest)), (2, rest, len(rest)), (6, "", 0)]
    assert corpus_pipeline.substrings(spark, again, small).where("text is null").count() == 1


def test_rows_without_doc_id(spark, small):
    """They pass untouched, link with nothing and take nothing; large ids stay exact beside them."""
    text, big = " ".join(f"w{i}" for i in range(40)), 2**62 + 1
    rows = [(None, text), (None, text), (None, "a"), (7, text + " end"), (big, " ".join(f"v{i}" for i in range(30)))]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    want = sorted(rows, key=repr)
    joined = ngram_join.ngram_join(docs).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in joined), key=repr) == sorted([(None, 36, None), (None, 36, None), (None, 1, None), (7, 37, 7), (big, 26, big)], key=repr)
    for stage in (corpus_pipeline.exact, corpus_pipeline.near, corpus_pipeline.substrings):
        assert sorted(((r.doc_id, r.text) for r in stage(spark, docs, small).collect()), key=repr) == want
    packed = corpus_pipeline.packed(spark, docs, small).collect()
    assert sorted((r.doc_id for r in packed), key=repr) == sorted((d for d, _ in rows), key=repr)
