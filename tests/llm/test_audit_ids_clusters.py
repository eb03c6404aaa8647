"""The filter audit, the binary id files and the clustering against plain definitions."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import centroid_clustering, filter_audit, huffman_ids
from tidemark.llm.common import new_folder
from tidemark.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKENIZER = "word_bpe_49k.json"
DOCS = "doc_id long, text string, lang string, source string, mask int, n long, ids string, part string"


def frame(spark, rows):
    """Documents of (doc_id, text, source) with more columns, some named like the operators' own."""
    return spark.createDataFrame([(d, t, None, s, 9, 9, "x", "y") for d, t, s in rows], DOCS).repartition(3)


def odd_documents(seed=3, n=120):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 6))) for _ in range(300)]
    rows = [(0, None, "a"), (1, "", None), (2, " \n\t ", ""), (3, "x y", "a"), (3, "x y", "a"), (4, "x y", "b"), (None, "x y", "a"), (None, None, None), (2**62, "x y", "b"), (-5, "Ünï #1", "a")]
    for d in range(10, n):
        w = rng.choices(words, k=rng.choice([3, 49, 50, 51, 300]))
        if rng.random() < 0.3:
            w[::2] = [w[0]] * len(w[::2])
        if rng.random() < 0.3:
            w = [x.upper() if rng.random() < 0.2 else x for x in w]
        if rng.random() < 0.2:
            w[-1] += rng.choice("#$%&*|")
        text = rng.choice([" ", "\n", " \x0b"]).join(w) if rng.random() < 0.8 or d < 20 else rows[rng.randrange(10, len(rows))][1]
        rows.append((d, text, rng.choice(["a", "a", "b", "c", None])))
    return rows


def plain_audit(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    docs = []
    for d, text, source in rows:
        t = text or ""
        w = WORD.findall(t)
        fails = {
            "A": len(w) < 50,
            "B": 100 * len(set(w)) < 65 * len(w),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t),
            "D": any(c in "#$%&*|" for c in t),
            "E": d is not None and any(x is not None and x < d and (y or "") == t for x, y, _ in rows),
        }
        docs.append((source or "", {f for f, x in fails.items() if x}, d in good, d in toxic))
    out = {}
    for part in {p for p, *_ in docs}:
        own = [x for x in docs if x[0] == part]
        gone = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                lost, left = [x for x in left if f in x[1]], [x for x in left if f not in x[1]]
                gone[f] += len(lost)
                out[part, "".join(order), step] = [len(left), len(lost), sum(f in x[1] for x in own) - len(lost), sum(x[1] == {f} for x in own), sum(x[2] for x in lost), sum(x[3] for x in lost)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(gone[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_audit_as_counted_order_by_order(spark):
    rows = odd_documents()
    labels = [(3, 1, 0), (3, 0, 1), (4, 1, None), (None, 1, 1), *((d, d % 2, d % 3 == 0) for d in range(10, 90))]
    marks = spark.createDataFrame([(d, q, None if t is None else int(t), "z") for d, q, t in labels], "doc_id long, quality int, toxic int, part string")
    got = filter_audit.filter_audit(frame(spark, rows), marks).collect()
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got} == plain_audit(rows, labels)
    assert len(got) == 600 * 4


def test_audit_of_nothing(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_audit(frame(spark, []), labels).count() == 0


def test_very_long_text_fails_as_a_short_one():
    assert filter_audit.failures(b"word " * 1_000_000) == filter_audit.failures(b"word " * 100) == 2
    assert filter_audit.failures(b"A" * 3_000_000) == 1 | 4


@pytest.mark.parametrize("seed", range(5))
def test_swapped_diagrams_equal_fresh_ones(seed):
    rng = random.Random(seed)
    counted = {m: (rng.randint(1, 9), rng.randint(0, 1), 0) for m in rng.sample(range(32), rng.choice([1, 5, 20, 32]))}
    diagram, seen = filter_audit.Diagram(counted, [0, 1, 2, 3, 4]), {(0, 1, 2, 3, 4)}
    for level in filter_audit.adjacent_swaps(5):
        diagram.swap(level)
        seen.add(tuple(diagram.order))
        fresh = filter_audit.Diagram(counted, diagram.order)
        assert [(f, *r, *k) for f, r, k in diagram.steps()] == [(f, *r, *k) for f, r, k in fresh.steps()]
        assert sum(x is not None for x in diagram.node) == sum(x is not None for x in fresh.node)
    assert len(seen) == math.factorial(5)


def best_cost(counts, limit):
    """Bits of the best code by trying all lengths that a prefix code can have."""
    best = None
    for lengths in itertools.product(range(1, limit + 1), repeat=len(counts)):
        if sum(2.0**-x for x in lengths) <= 1:
            cost = sum(c * x for c, x in zip(counts, lengths))
            best = cost if best is None else min(best, cost)
    return best


@pytest.mark.parametrize("counts,limit", [([1, 1], 3), ([5, 1, 1, 1], 3), ([50, 20, 9, 4, 1], 3), ([50, 20, 9, 4, 1], 4), ([1, 1, 1, 1, 1, 1], 3), ([100, 1, 1, 2, 3], 4)])
def test_code_is_the_best_within_its_limit(counts, limit):
    lengths = huffman_ids.code_lengths(np.array(counts), limit)
    assert max(lengths) <= limit and sum(2.0 ** -int(x) for x in lengths) <= 1
    assert sum(c * int(x) for c, x in zip(counts, lengths)) == best_cost(counts, limit)


def test_canonical_codes_are_prefix_free_and_in_order():
    counts = np.random.default_rng(1).integers(0, 50, 3000) ** 3
    lengths = huffman_ids.code_lengths(counts, 14)
    codes = huffman_ids.canonical(lengths)
    assert ((lengths == 0) == (counts == 0)).all() and lengths.max() <= 14
    text = sorted((format(codes[i], f"0{lengths[i]}b"), lengths[i], i) for i in np.flatnonzero(lengths))
    assert not any(b[0].startswith(a[0]) for a, b in itertools.pairwise(text))
    assert text == sorted(text, key=lambda x: (x[1], x[2]))
    with pytest.raises(ValueError):
        huffman_ids.code_lengths(counts, 5)


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 5000])
def test_ids_come_back_from_bits(n):
    rng = np.random.default_rng(n)
    counts = rng.integers(1, 1000, 700) ** 2
    lengths = huffman_ids.code_lengths(counts, 12)
    ids = rng.integers(0, 700, n)
    offsets, bits = huffman_ids.encode(ids, huffman_ids.canonical(lengths), lengths)
    text = "".join(format(huffman_ids.canonical(lengths)[i], f"0{lengths[i]}b") for i in ids)
    assert bits == bytes(int(text[k : k + 8].ljust(8, "0"), 2) for k in range(0, len(text), 8))
    assert len(offsets) == -(-n // huffman_ids.STEP)
    blocks = [(n, offsets, memoryview(bits))] * 3
    assert (huffman_ids.decode(blocks, huffman_ids.decoding_table(lengths, 12), 12) == np.tile(ids, 3)).all()


def test_documents_span_blocks():
    lengths = huffman_ids.code_lengths(np.ones(10, np.int64), 4)
    docs = [(None, np.arange(10)), (1, np.arange(7)), (2, np.tile(np.arange(10), 9)), (3, np.array([5]))]
    content = b"\n".join([*huffman_ids.blocks(4, iter(docs), lengths, most=16), b""])
    got = [r for b in huffman_ids.documents(content, 4, huffman_ids.decoding_table(lengths, 4), together=2) for r in b.to_pylist()]
    assert [(r["file"], r["doc_id"], r["start"], r["n_tokens"]) for r in got] == [(4, None, 0, 10), (4, 1, 10, 7), (4, 2, 17, 90), (4, 3, 107, 1)]
    assert [r["ids_crc32"] for r in got] == [zlib.crc32(x.astype("<u4").tobytes()) for _, x in docs]
    with pytest.raises(ValueError):
        list(huffman_ids.records(content[:-1]))


def test_files_hold_the_tokenizers_ids(spark):
    tokenizer = Tokenizer.from_file(tokenizer_path(TOKENIZER))
    rows = [*odd_documents(), (5000, "long text, " * 60_000, "a"), (5001, "w" * 200_000, None)]
    got = [tuple(r) for r in huffman_ids.round_trip(frame(spark, rows), tokenizer_path(TOKENIZER)).select("start", "doc_id", "n_tokens", "ids_crc32").collect()]
    ids = [(d, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]) for d, t, _ in rows]
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    want, at = [], 0
    for d, x in sorted(ids, key=lambda p: (p[0] is not None, p[0] or 0, len(p[1]), crc(p[1]))):
        want.append((at, d, len(x), crc(x)))
        at += len(x)
    assert sorted(got) == want
    assert huffman_ids.round_trip(frame(spark, []), tokenizer_path(TOKENIZER)).count() == 0


def test_files_lie_in_ascending_order(spark):
    path = new_folder(spark, "files")
    huffman_ids.write(frame(spark, odd_documents()), path, tokenizer_path(TOKENIZER))
    by_file = huffman_ids.read(spark, path).where("doc_id is not null").groupBy("file").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).orderBy("file").collect()
    assert len(by_file) > 1 and all(x.b <= y.a for x, y in itertools.pairwise(by_file))


def plain_clusters(rows, k=16, rounds=3, dims=64):
    kept = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) and math.isfinite(64.0 * x) for x in v)]
    start = sorted(((hashlib.sha256(f"1:{i}".encode()).hexdigest(), i, v) for i, v in kept if i is not None))
    centroids = [v for *_, v in start[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for n in range(len(centroids)):
            own = [v for (_, v), c in zip(kept, of) if c == n]
            if own:
                centroids[n] = [sum(x) // len(own) for x in zip(*own)]
    found = [(i, *near(v)) for i, v in kept]
    inertia = [sum(d for _, d, c in found if c == n) for n in range(len(centroids))]
    long = lambda x: x if x < 2**63 else None
    return sorted(((i, c, long(d), long(inertia[c]), long(sum(inertia)), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, d, c in found), key=str)


def clusters(spark, rows, kind="float", **more):
    df = spark.createDataFrame([(i, v, 3, "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, cluster int, q string").repartition(3)
    return sorted((tuple(r) for r in centroid_clustering.cluster(df, **more).collect()), key=str)


def normal(n, seed, scale=1.0, near=5):
    """Vectors around a few centres, so that bounds settle most of them, rounded to floats."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(near, 64))
    return [(i, (scale * (centres[rng.integers(near)] + rng.normal(size=64) * 0.3)).astype(np.float32).tolist()) for i in range(n)]


@pytest.mark.parametrize("seed,near", [(1, 3), (2, 40)])
def test_clusters_as_by_hand(spark, seed, near):
    rows = normal(400, seed, near=near)
    assert clusters(spark, rows) == plain_clusters(rows)


def test_clusters_with_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) / 64 for x in rng.integers(-1, 2, 64)]) for i in range(150)]
    rows += [(7, rows[3][1]), (7, rows[3][1]), (900, rows[0][1]), (901, rows[0][1]), (None, rows[5][1]), (902, None), (903, []), (904, [0.5] * 63), (905, [0.5] * 65)]
    rows += [(906, [None, *[0.5] * 63]), (907, [math.nan, *[0.5] * 63]), (908, [math.inf, *[0.5] * 63]), (-909, [-0.001] * 64)]
    assert clusters(spark, rows) == plain_clusters(rows)
    same = [(i, rows[0][1]) for i in range(40)]
    assert clusters(spark, same) == plain_clusters(same)


def test_clusters_of_few_and_of_no_vectors(spark):
    for n in (0, 1, 2, 9):
        assert clusters(spark, normal(n, 6)) == plain_clusters(normal(n, 6))


def test_clusters_of_enormous_numbers(spark):
    rows = normal(60, 8) + [(1000 + i, v) for i, v in normal(30, 9, scale=1e6)] + [(2000 + i, v) for i, v in normal(5, 10, scale=1e20)]
    rows += [(3000, [1e306] * 64), (3001, [1e307] * 64), (3002, [-1e306] * 64)]
    assert clusters(spark, rows, "double") == plain_clusters(rows)


def test_bounds_spare_most_comparisons():
    rows = centroid_clustering.exact(np.floor(64 * np.array([v for _, v in normal(2000, 11, near=16)])))
    centres = [[int(x) for x in rows[i]] for i in range(16)]
    cluster, second, upper, lower = np.zeros(2000, np.int32), np.ones(2000, np.int32), np.full(2000, math.inf), np.zeros(2000)
    centroid_clustering.Centroids(centres, None).assign(rows, cluster, second, upper, lower)
    moved, asked = [[x + 1 for x in c] for c in centres], []
    later = centroid_clustering.Centroids(moved, centres)
    search = later._search
    later._search = lambda q, *a: (asked.append(len(q)), search(q, *a))
    later.assign(rows, cluster, second, upper, lower)
    want = ((rows[:, None, :] - np.array(moved)[None]) ** 2).sum(-1)
    assert (want.argmin(1) == cluster).all()
    assert sum(asked) < 1500
    assert (np.sqrt(want.min(1)) <= upper).all() and (np.sqrt(np.partition(want, 1, axis=1)[:, 1]) >= lower).all()
