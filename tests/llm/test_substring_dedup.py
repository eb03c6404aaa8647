"""Substring dedup against brute force, its index and its cases."""

import json
import random

import pytest

from tests.llm import brute
from tidemark.llm import substring_dedup as op
from tidemark.llm.common import table

SCHEMA = "doc_id long, text string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def got(result):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in result.collect()}


def want(rows):
    return {d: v[:3] for d, v in brute.substrings(rows).items()}


def passages(seed, documents=120):
    """Documents that share passages of all lengths, at both sides of 13 words, some of them in most documents."""
    rng = random.Random(seed)
    common = [[f"c{k}w{i}" for i in range(rng.randrange(8, 40))] for k in range(12)]
    out = []
    for d in rng.sample(range(10**6), documents):
        text = []
        for _ in range(rng.randrange(6)):
            part = common[min(rng.randrange(12), rng.randrange(12))]
            low = rng.randrange(len(part))
            text += part[low : low + rng.randrange(5, 40)]
            text += [f"{rng.choice('xyz')}{rng.randrange(50)}" for _ in range(rng.randrange(12))]
        out.append((d, rng.choice([" ", "\n", "\t "]).join(text)))
    return out


@pytest.mark.parametrize("share_docs", [1024, 3])
def test_against_brute_force(spark, share_docs):
    """Fingerprints in one share, and dealt to many (3 documents in each)."""
    rows = passages(share_docs)
    result = op.substring_dedup(frame(spark, rows).repartition(5), share_docs=share_docs, with_text=True)
    assert got(result) == want(rows)
    whole = brute.substrings(rows)
    assert sum(v[1] for v in whole.values()) > 1000
    assert all(r.text == (whole[r.doc_id][3] if r.n_removed else dict(rows)[r.doc_id]) for r in result.collect())


def test_whole_table(spark, small):
    docs = table(spark, small, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(op.substring_dedup(docs)) == want(rows)


def test_index_goes_on_from_its_manifest(spark):
    """Batches answer as the whole table does, across compactions and a job that opens the index again."""
    rows = sorted(passages(7))
    found, index = {}, op.FingerprintIndex(spark, fanout=2)
    root, compactions = index.root, 0
    for at in range(0, len(rows), 24):
        index = op.FingerprintIndex(spark, root, fanout=2)
        found |= got(op.dedup_batch(index, frame(spark, rows[at : at + 24]), frame(spark, rows[:at])))
        compactions += index.compactions
        assert len(index.runs) <= 2
    assert found == want(rows)
    assert compactions >= 2
    # runs are sorted, a row for each fingerprint, and merged without a shuffle or a sort of history
    run = spark.table(index.runs[0])
    assert run.count() == run.select("h").distinct().count()
    with op.settings(spark, **op.MERGING):
        plan = run.alias("a").join(run.hint("merge").alias("b"), "h")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
    lines = [json.loads(r[0]) for r in spark.read.text(f"{root}/manifest-*").collect()]
    assert max(lines, key=lambda m: m["version"])["runs"] == index.runs
    index.drop()


def test_edges(spark):
    """Null, empty and very long texts, no rows, rows without doc_id, repeated rows, ids of two texts, other columns."""
    words = [f"w{i}" for i in range(60)]
    passage, other = " ".join(words[:20]), " ".join(words[20:40])
    assert op.substring_dedup(frame(spark, [])).count() == 0
    assert op.substring_dedup(frame(spark, [(None, passage)])).count() == 1
    rows = [(1, passage), (2, passage + " end"), (2, passage + " end"), (2, "a " + other), (3, other), (None, passage), (None, passage), (4, None), (5, ""), (6, " \n"), (7, " ".join(words[:12]))]
    docs = frame(spark, rows).selectExpr("doc_id", "text", "1 as n_words", "'x' as h", "2 as places", "3 as words")
    out = sorted(((r.doc_id, r.n_words, r.n_removed) for r in op.substring_dedup(docs).collect()), key=repr)
    assert out == sorted([(1, 20, 0), (2, 21, 20), (2, 21, 20), (2, 21, 0), (3, 20, 20), (None, 20, 0), (None, 20, 0), (4, 0, 0), (5, 0, 0), (6, 0, 0), (7, 12, 0)], key=repr)
    # within itself a document keeps what it repeats; a smaller one takes it all
    long = " ".join(f"v{i % 997}" for i in range(300_000))
    assert {d: v[1] for d, v in got(op.substring_dedup(frame(spark, [(5, long), (9, long + " end")]))).items()} == {5: 0, 9: 300_000}


def test_words_decide():
    """With a hash that takes many words for one another, results stay the same."""
    rows = [(d, t.encode()) for d, t in passages(3, 30)]
    by = {}

    def coarse(words):
        return op.anchors_of(op.np.array([len(w) % 3 for w in words], op.np.uint64), op.np.array([0, len(words)]))

    for d, t in sorted(rows):
        words = t.split()
        for h, _, first, count in zip(*(x.tolist() for x in coarse(words)), strict=True):
            by.setdefault(h, []).append((d, b" ".join(words[first : first + count + op.SIZE - 1]), first))
    first = {}
    lost = 0
    for group in by.values():
        for (d, stretch, _), (gone, stays) in zip(group, op.compared([r[:2] for r in group]), strict=True):
            for k, window in enumerate(op.windows_of(stretch)):
                assert (gone >> k & 1) != (stays >> k & 1)
                assert (gone >> k & 1) == (first.setdefault(window, d) < d)
                lost += gone >> k & 1
    assert lost
