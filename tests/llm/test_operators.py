import base64
import hashlib
import html as html_entities
import random
import re
import uuid
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, models, normalizers, pre_tokenizers

from tests.llm import brute
from tidemark.llm import components, exact_dedup, html_extract, ngram_join, packing, pieces, quality_classifier, quality_rules, sentencepiece_fst, token_count, warc, word_ids
from tidemark.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, count long, h long, kept string"


def frame(spark, texts):
    """Documents with more columns, some named like the operators' own."""
    rows = [(d, t, None, "s", None, 7, 1, "x") for d, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def invented(seed=5, n=160):
    """Texts with exact copies, near copies, shared passages, short, empty and null ones."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdeé", k=rng.randint(1, 6))) for _ in range(400)]
    passage = rng.choices(vocabulary, k=60)
    out = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "ONE"), (5, "a b c d"), (6, "A  b\nc d"), (7, "x\x1cy\xa0z \x0b q"), (8, None)]
    family = None
    for d in range(len(out), n):
        kind = rng.random()
        if kind < 0.15 and family:
            w = list(family)
            for _ in range(rng.randint(0, max(1, len(w) // 40))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
        elif kind < 0.3:
            w = rng.choices(vocabulary, k=rng.randint(3, 60))
            at = rng.randrange(len(w))
            w[at:at] = passage[rng.randint(0, 20) :]
        elif kind < 0.4 and len(out) > 20:
            w = brute.words(out[rng.randrange(10, len(out))][1])
        elif kind < 0.5:
            w = rng.choices(vocabulary, k=9) * rng.randint(1, 6)
        else:
            family = w = rng.choices(vocabulary, k=rng.choice([4, 5, 12, 13, 14, 40, 200, 600]))
        out.append((d, "".join(x + rng.choice([" ", " ", " ", "\n", "  ", "\t"]) for x in w)))
    return out


@pytest.fixture(scope="module")
def texts():
    return invented()


@pytest.fixture(scope="module")
def docs(spark, texts):
    return frame(spark, texts).cache()


EMPTY = []


def test_exact(docs, texts, spark):
    rows = exact_dedup.exact_dedup(docs).collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in rows} == brute.exact(texts)
    assert len(rows) == len(texts)
    assert exact_dedup.exact_dedup(frame(spark, EMPTY)).count() == 0


def test_exact_ties_and_longest(spark):
    rows = [(9, "a b"), (4, "ab"), (3, "a\n b "), (5, "a\n b "), (-7, "zz"), (2**62, "z z")]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_dedup(frame(spark, rows), salts=2).collect()}
    assert got == brute.exact(rows)


def test_exact_of_a_common_text(spark):
    """A text of most rows is looked up under many salts; rows without doc_id never stay."""
    rows = [(d, "common text" + " " * (d % 7)) for d in range(3000)] + [(3000 + d, f"other {d}") for d in range(500)]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_dedup(frame(spark, rows)).collect()}
    assert got == brute.exact(rows)
    out = sorted((r.doc_id or -1, r.keep_id or -1, r.group_size, r.kept) for r in exact_dedup.exact_dedup(frame(spark, [(None, "a"), (None, "b  "), (5, "b"), (None, None)])).collect())
    assert out == [(-1, -1, 1, False), (-1, -1, 1, False), (-1, 5, 2, False), (5, 5, 2, True)]


def test_exact_of_clashing_digests(spark, monkeypatch):
    """Different texts under one digest stay apart."""
    monkeypatch.setattr(exact_dedup, "digest", lambda text: F.unhex(F.lit("00")))
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda column, bits: F.lit("00"))
    rows = [(d, f"text {d % 4}") for d in range(40)]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(frame(spark, rows)).collect()}
    assert got == {d: v[:3] for d, v in brute.exact(rows).items()}


def test_near(docs, texts, spark):
    rows = ngram_join.ngram_join(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute.near(texts)
    assert ngram_join.ngram_join(frame(spark, EMPTY)).count() == 0


def test_near_chunks_of_a_block(spark, monkeypatch):
    """Blocks over the chunk size are compared chunk by chunk."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for d in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(80)] = f"x{rng.randrange(10**6)}"
        rows.append((d, " ".join(w)))
    monkeypatch.setattr(ngram_join, "CHUNK", 7)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(frame(spark, rows)).collect()}
    assert got == brute.near(rows)


def test_near_threshold_is_exact(spark):
    """Three quarters of the union link; a shingle less doesn't."""
    base = [f"w{i}" for i in range(19)]  # 15 shingles
    rows = [(1, " ".join(base)), (2, " ".join(base + [f"y{i}" for i in range(5)])), (3, " ".join([f"z{i}" for i in range(6)] + base))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(frame(spark, rows)).collect()}
    assert got == brute.near(rows) == {1: (15, 1), 2: (20, 1), 3: (21, 3)}


def test_mixed_blocks_by_size(spark, monkeypatch):
    """Chunks of a block follow the sizes, stay small, and lose no pair that the bound lets through."""
    import numpy as np

    rng = np.random.default_rng(5)
    base, rows, members = rng.integers(0, 2**63, 400).astype(np.uint64), [], []
    for i in range(150):
        s = np.unique(rng.choice(base, int(rng.choice([30, 40, 40, 55, 90, 160, 300])), replace=False))
        rows.append((i, len(s), bytearray(ngram_join.point(s).tobytes())))
        members += [(p, i, i % 5) for p in (0, 1) if p == 0 or rng.random() < 0.3]
    points = spark.createDataFrame(rows, "id long, n long, point binary")
    mixed = spark.createDataFrame(members, "pivot long, id long, component long")
    monkeypatch.setattr(ngram_join, "CHUNK", 8)
    strata = ngram_join._strata(mixed, points).cache()
    for r in strata.collect():
        assert r["from"] <= r["first"] <= r["last"] <= r["to"]
    dealt = ngram_join._candidates(mixed, points, strata)
    size, raw = {r[0]: r[1] for r in rows}, {r[0]: bytes(r[2]) for r in rows}
    want = set()
    for p in (0, 1):
        own = [(i, c) for q, i, c in members if q == p]
        for v, c in own:
            for u, d in own:
                if u > v and c != d and ngram_join.fits(np.array([size[u]]), np.array([size[v]]), [raw[u]], [raw[v]])[0]:
                    want.add((u, v))
    assert {(r.u, r.v) for r in dealt.collect()} == want and want
    reach = {r["n"]: (r["from"], r["to"]) for r in strata.where("pivot = 0").collect()}
    assert reach[30][1] < reach[300][0]  # far sizes never meet


def test_tree_finds_all_pairs():
    import numpy as np

    rng = np.random.default_rng(1)
    sets = []
    for _ in range(200):
        s = rng.integers(0, 2**63, rng.integers(5, 60)).astype(np.uint64)
        sets.append(np.unique(s))
        sets.append(np.unique(np.concatenate([s[: int(len(s) * rng.uniform(0.6, 1))], rng.integers(0, 2**63, 3).astype(np.uint64)])))
    vectors = np.array([ngram_join.folded(ngram_join.point(s), 32) for s in sets], np.int32)
    sizes = np.array([len(s) for s in sets])
    every = np.arange(len(sets))
    found = {(a, b) for i, j in ngram_join.RTree(sizes, vectors, leaf=8).pairs(every, every) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
    assert len(found) < len(sets) ** 2 / 4
    for a in range(len(sets)):
        for b in range(len(sets)):
            shared = len(np.intersect1d(sets[a], sets[b]))
            if 100 * shared >= 75 * (sizes[a] + sizes[b] - shared):
                assert (a, b) in found


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 105), (105, 102), (7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 105: 100, 102: 100}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_statistics(docs, texts):
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_rules.statistics(docs).collect()}
    assert got == {d: brute.statistics(t) for d, t in texts}


def test_rules(spark, small):
    from tidemark.llm.common import table

    docs, labels = table(spark, small, "documents"), table(spark, small, "labels")
    rules = quality_rules.learn(quality_rules.labelled_sample(docs, labels, 6000))
    assert rules
    rows = {r.doc_id: r for r in quality_rules.quality_rules(docs, labels).collect()}
    assert len(rows) == docs.count()
    tests = {"above": lambda v, c: v > c, "below": lambda v, c: v <= c}
    stats = {r.doc_id: r for r in quality_rules.statistics(docs).selectExpr("doc_id", *(f"{e} as {f}" for f, e in quality_rules.FEATURES.items())).collect()}
    for d, t in docs.select("doc_id", "text").collect():
        r, s = rows[d], brute.statistics(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == s
        assert r.base_failed == (s[0] < 20 or 100 * s[4] > 30 * s[0])
        hit = next((k for k, rule in enumerate(rules, 1) if all(tests["above" if x.above else "below"](stats[d][x.feature], x.cut) for x in rule)), None)
        assert (r.rule, r.kept) == (hit, not r.base_failed and hit is None)
    known = labels.collect()
    good = [rows[x.doc_id].kept for x in known if x.quality == 1 and not rows[x.doc_id].base_failed]
    bad = [rows[x.doc_id].kept for x in known if x.quality == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.2 * len(bad)


def test_rules_without_labels(docs, spark, texts):
    rows = quality_rules.quality_rules(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert len(rows) == len(texts) and all(r.kept == (not r.base_failed) for r in rows)
    kept = quality_rules.kept_documents(docs, spark.createDataFrame([(9, None, 1)], "doc_id long, quality int, toxic int"))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.kept}


def unigram():
    vocabulary = pieces.load(tokenizer_path("piece_bpe_32k.model"))
    t = Tokenizer(models.Unigram([(p, s) for p, s, _ in vocabulary.pieces], 0, True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return t


ODD = ["", " ", "  a", "▁x", "a▁ b", "日本語 текст ñandú", "😀 ok", "line\n\nfeed \n x", "a\tb", "<0x41> <s> </s>", "zzzz qqqq\x00", "é é", " lead", "trail "]


def costs(vocabulary, text):
    """Least cost of splitting a text into pieces and bytes; a plain recurrence from the right over a dictionary."""
    text = ("▁" + text).replace(" ", "▁") if text else ""
    cost = {p: -s for p, s, kind in vocabulary.pieces if kind in pieces.MATCHED}
    longest, best = max(map(len, cost)), [0.0] * (len(text) + 1)
    for at in range(len(text) - 1, -1, -1):
        ways = [cost[text[at:end]] + best[end] for end in range(at + 1, min(len(text), at + longest) + 1) if text[at:end] in cost]
        if text[at] not in cost:
            ways.append(best[at + 1] - vocabulary.unknown_score)
        best[at] = min(ways)
    return best[0]


def cost_of(vocabulary, ids):
    total, at = 0.0, 0
    while at < len(ids):
        piece, score, kind = vocabulary.pieces[ids[at]]
        if kind == pieces.BYTE:
            first = int(piece[3:5], 16)
            total, at = total - vocabulary.unknown_score, at + (1 if first < 128 else 2 if first < 224 else 3 if first < 240 else 4)
        else:
            total, at = total - score, at + 1
    return total


def all_paths(vocabulary, text):
    """(cost, starts of the pieces from the last to the first, ids) of every path of a short text."""
    text = ("▁" + text).replace(" ", "▁") if text else ""
    at = {p: (i, -s) for i, (p, s, kind) in enumerate(vocabulary.pieces) if kind in pieces.MATCHED}

    def paths(end):
        if not end:
            yield 0.0, (), ()
        for begin in range(end):
            if text[begin:end] in at:
                i, own = at[text[begin:end]]
                for cost, starts, ids in paths(begin):
                    yield cost + own, (begin, *starts), (*ids, i)
            elif begin == end - 1:
                for cost, starts, ids in paths(begin):
                    yield cost - vocabulary.unknown_score, (begin, *starts), (*ids, *vocabulary.spelt(text[begin]))

    return paths(len(text))


SPECIAL = ["a<s>b", "<unk></s>", "<0x41>", " a", "a  b   c ", "\n \n", "\t\ta", "😀 漢字\u0301", "\x00", "▁▁ x", "  "]


def test_transducer_is_the_shortest_path(spark, small, texts):
    """Whole documents cost what a plain recurrence finds; the counter agrees; decoding gives the text back."""
    path = tokenizer_path("piece_bpe_32k.model")
    vocabulary = pieces.load(path)
    rows = texts + [(1000 + i, t) for i, t in enumerate(ODD + SPECIAL)]
    rows += [(5000 + r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").limit(60).collect()]
    encoded = sentencepiece_fst.encode(frame(spark, rows), path)
    got = {r.doc_id: r.ids for r in encoded.collect()}
    assert {d: cost_of(vocabulary, got[d]) for d, _ in rows} == {d: costs(vocabulary, t or "") for d, t in rows}
    assert {r.doc_id: r.n_tokens for r in token_count.token_counts(frame(spark, rows), path).collect()} == {d: len(got[d]) for d, _ in rows}
    back = {r.doc_id: r.text for r in sentencepiece_fst.decode(encoded, path).collect()}
    assert all(back[d] == (t or "").replace("▁", " ") for d, t in rows)
    trip = {r.doc_id: r for r in sentencepiece_fst.round_trip(frame(spark, rows), path).collect()}
    assert all(trip[d].lossless == ("▁" not in (t or "")) and trip[d].n_pieces == len(got[d]) for d, t in rows)
    assert sentencepiece_fst.encode(frame(spark, []), path).count() == 0 and token_count.token_counts(frame(spark, []), path).count() == 0


def test_ties_take_the_earliest_start():
    """Among all paths of least cost: the last piece begins earliest, then the one before it, and so on."""
    names = ["a", "b", "▁", "ab", "ba", "aab", "aa", "▁a", "▁▁", "bb"]
    byte = [(f"<0x{b:02X}>", 0.0, pieces.BYTE) for b in range(256)]
    rng = random.Random(6)
    for prefix in (True, False):
        vocabulary = pieces.Vocabulary([("<s>", 0.0, pieces.CONTROL), *byte, *((n, -float(len(n)), pieces.NORMAL) for n in names)], True)
        machine, counter = sentencepiece_fst.Transducer(vocabulary), token_count.Counter(vocabulary)
        for _ in range(150):
            text = "".join(rng.choices("aab cé", k=rng.randint(0, 9)))
            _, _, ids = min(all_paths(vocabulary, text))
            assert tuple(machine.encode(text)) == ids and counter.of(text) == len(ids)


def test_composition():
    """A composed machine maps each input as its two machines do one after the other."""
    vocabulary = pieces.Vocabulary([*((f"<0x{b:02X}>", 0.0, pieces.BYTE) for b in range(256)), ("▁", -3.0, pieces.NORMAL), ("▁x", -2.0, pieces.NORMAL), ("xy", -1.5, pieces.NORMAL), ("y", -1.0, pieces.NORMAL)])
    machine = sentencepiece_fst.composed(sentencepiece_fst.normaliser(vocabulary), sentencepiece_fst.pieces_or_bytes(vocabulary), vocabulary.spelt)

    def outputs(state, text):
        """All (cost, ids) that the machine gives for a text."""
        for output, cost, to in machine.arcs[state].get(sentencepiece_fst.NONE, ()):
            yield from ((cost + c, (*output, *rest)) for c, rest in outputs(to, text))
        if not text and state in machine.final:
            yield 0.0, ()
        for output, cost, to in text and (machine.arcs[state].get(text[0]) or machine.arcs[state].get(sentencepiece_fst.OTHER, ())):
            written = vocabulary.spelt(text[0]) if output == sentencepiece_fst.BYTES else output
            yield from ((cost + c, (*written, *rest)) for c, rest in outputs(to, text[1:]))

    for text in ("x", "xy", "xyy x", "é x", " y", "▁xz"):
        assert sorted(outputs(0, text)) == sorted((c, i) for c, _, i in all_paths(vocabulary, text))


def test_models_that_normalise_more(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(tokenizer_path("piece_bpe_32k.model"), "rb") as f:
        model.ParseFromString(f.read())
    model.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "m").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError):
        pieces.load(str(tmp_path / "m"))


def test_packing(docs, texts, spark):
    path = tokenizer_path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = texts + [(5000, "word " * 9000), (5001, "<|endoftext|>a <|startoftext|>")] + [(6000 + i, t) for i, t in enumerate(ODD)]
    bins, tokens = brute.packed(rows, tokenizer, packing.best_fit_packing(frame(spark, rows), path).collect())
    assert bins <= -(-tokens // 2048) + 1
    assert packing.best_fit_packing(frame(spark, EMPTY), path).count() == 0
    assert isinstance(normalizers.Replace(Regex("x"), "y"), normalizers.Normalizer)


def test_other_tokenizers_read_whole_texts(spark):
    """A tokenizer that joins a space with the word after it has no runs."""
    path = tokenizer_path("byte_bpe_50k.json")
    assert word_ids.WordIds(tokenizer_path("word_bpe_49k.json")).split is word_ids.split_runs and word_ids.WordIds(path).split is not word_ids.split_runs
    rows = [(1, "Two words  and\nlines"), (2, None), (3, " Lead"), (4, "x" * 300)]
    brute.packed(rows, Tokenizer.from_file(path), packing.best_fit_packing(frame(spark, rows), path).collect())


def test_packing_in_groups(spark, texts):
    path = tokenizer_path("word_bpe_49k.json")
    found = packing.pieces(frame(spark, texts), path, 256)
    brute.packed(texts, Tokenizer.from_file(path), packing.pack(found, 256, group_rows=40).collect(), 256)


def test_swaps_fill_bins():
    """Best fit leaves 6+4+4, 6+5, ...; exchanges make full bins."""
    rng = random.Random(2)
    for _ in range(50):
        lengths = [rng.randint(1, 60) for _ in range(rng.randint(1, 120))]
        first = packing.best_fit(lengths, 100)
        better = packing.improve([list(b) for b in first], lengths, 100)
        assert sorted(i for b in better for i in b) == list(range(len(lengths)))
        fills = [sum(lengths[i] for i in b) for b in better]
        assert max(fills) <= 100 and len(better) <= len(first)
        assert sum(f * f for f in fills) >= sum(sum(lengths[i] for i in b) ** 2 for b in first)
    lengths = [6, 6, 5, 5, 4, 4]
    bins = [[0, 2], [1, 3], [4, 5]]
    assert len(packing.improve(bins, lengths, 15)) == 2


def test_swaps_reach_all_bins():
    """Best fit leaves a quarter more bins than tokens need; the search goes on until nothing gains."""
    rng = random.Random(4)
    lengths = [rng.randint(600, 760) for _ in range(8000)]
    first = packing.best_fit(lengths, 2048)
    better = packing.improve([list(b) for b in first], lengths, 2048)
    assert sorted(i for b in better for i in b) == list(range(len(lengths)))
    assert max(sum(lengths[i] for i in b) for b in better) <= 2048
    assert len(better) <= 0.93 * len(first)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
%s<aside>Side</aside><form><p>Search</p><input></form><div id="comments"><p>First!</p></div><footer>&copy; me</footer></body></html>"""


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain &amp; text", "plain & text"),
        (PAGE % "<article><h1>Head</h1><p><b>Short<br><p>A  long\n para&shy;graph of &lt;text&gt; with <i>in</i>line.</p><div class='ad'>Buy</div><p>End</article>", "Head Short A long para\xadgraph of <text> with inline. End"),
        (PAGE % "<main><h2>Top</h2><ul><li>one<li>two</ul></main>", "Top one two"),
        ("<article><p>Open <b>bold<p>next", "Open bold next"),
        ("<article>x<![weird y</article>", "x<![weird y"),
        ("<article><!-- <p>no</p> -->yes</article>", "yes"),
        ("<div class='content no-sidebar'><p>Some words that make a text.</p></div>", "Some words that make a text."),
        ("<div class='layout has-header'><p>Some words that make a text.</p></div>", "Some words that make a text."),
        ("<nav><a href='x'>n</a></nav><div id='search-results'><p>Some words that make a text.</p></div>", "Some words that make a text."),
        ("<div class='col-md-8 tags'><p>Some words that make a text.</p></div>", "Some words that make a text."),
        ("<article><div class='entry-meta-wrap'><p>Some words that make a text.</p></div></article>", "Some words that make a text."),
        ("<article><h1 class='post-header'>Title</h1><p>Some words that make a text.</p></article>", "Title Some words that make a text."),
        ("<article><p>One short</p></article><article><p>" + "long words " * 30 + "</p></article>", "One short " + "long words " * 29 + "long words"),
        ("<form><h1>Top</h1><p>" + "long words " * 30 + "</p></form><footer>" + "foot " * 200 + "</footer>", "Top " + "long words " * 29 + "long words"),
    ],
)
def test_html(html, text):
    assert html_extract.main_text(html) == text


def test_html_without_article():
    body = "<div><h1>Title</h1>" + "".join(f"<p>{'words of a long enough paragraph ' * 8}{i}</p>" for i in range(5)) + "</div>"
    got = html_extract.main_text(PAGE % body)
    assert got.startswith("Title words of") and got.endswith("paragraph 4") and "cookies" not in got and "First!" not in got


LONG = "".join(f"<p>{'words of a long enough paragraph ' * 8}{i}</p>" for i in range(5))


@pytest.mark.parametrize(
    "wrapped",
    [
        "<div class='content-sidebar-wrap'><main>%s<div class='ad'>Buy</div></main><div class='sidebar'>Side bar</div></div>",
        "<div class='layout has-sidebar'><article>%s<div class='ad'>Buy</div></article></div>",
        "<div id='page-header-below'><div class='x-widget-y'><div role='main'>%s</div></div></div>",
        "<div class='site-widget-area'><div>%s</div></div>",
        "<div><div>%s</div></div><article><h2>Teaser</h2><p>A short one.</p></article>",
        "<div>%s</div><div class='related'><article>Teaser one</article><article>Teaser two</article></div>",
        "<main><h2>More</h2></main><article>%s</article>",
    ],
)
def test_html_wrappers_and_teasers(wrapped):
    """A word of a class or id hides no article, and a small article no main text."""
    got = html_extract.main_text(PAGE % (wrapped % LONG))
    assert got.startswith("words of") and got.endswith("paragraph 4") and got.count("paragraph") == 40


def test_html_short_article_and_long_notice():
    assert html_extract.main_text(f"<article><p>Short</p></article><div class='cookie-notice'>{LONG}</div>") == "Short"
    assert html_extract.main_text(f"<div class='comments'><article>{LONG}</article></div><article>{LONG * 2}</article>").count("paragraph") == 80


def article_of(page):
    """The text of a page's one article, without a parser."""
    inside = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    return " ".join(html_entities.unescape(re.sub(r"<[^>]+>", "", re.sub(r"</?(?:p|h1|br)>", " ", inside))).split())


def test_html_of_the_table(spark, small, monkeypatch):
    """Every page of the table gives its article; without the threshold none does."""
    pages = spark.read.parquet(f"{small}/pages.parquet")
    rows = {r.page_id: r.html for r in pages.collect()}
    got = {r.page_id: (r.text, r.n_chars) for r in html_extract.extract(pages).collect()}
    want = {k: article_of(v) for k, v in rows.items()}
    assert got == {k: (t, len(t)) for k, t in want.items()}
    monkeypatch.setattr(html_extract, "threshold", lambda ratios: -1.0)
    assert not any(html_extract.main_text(v) == want[k] for k, v in rows.items())


def test_ratios():
    """Smoothing and clusters against plain sums."""
    import numpy as np

    ratios = [1.0, 2.0, 90.0, 80.0, 3.0, 100.0, 0.0, 0.0]
    kernel = [np.exp(-2.0), np.exp(-0.5), 1.0, np.exp(-0.5), np.exp(-2.0)]
    plain = []
    for k in range(len(ratios)):
        near = [(kernel[d + 2], ratios[k + d]) for d in range(-2, 3) if 0 <= k + d < len(ratios)]
        plain.append(sum(w * r for w, r in near) / sum(w for w, _ in near))
    assert np.allclose(html_extract.smoothed(np.array(ratios)), plain)
    assert html_extract.two_clusters(np.array([0.0, 1.0, 2.0, 50.0, 60.0])) == (1.0 + 55.0) / 2
    assert html_extract.threshold(np.array([5.0, 5.0])) == 0.0


def test_html_table(spark, small):
    rows = [(1, "u", "<article>a</article>", 3), (1, "u", "<article>a</article>", 3), (2, None, None, None)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert sorted((r.page_id, r.url, r.text, r.n_chars) for r in got if r.url) == [(1, "u", "a", 1)] * 2 and got[-1].n_chars in (0, 1)
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc(spark):
    rows = [(1, "http://a/?é", "<html><head><title>T</title><script>x</script></head><body><p>One &amp; <b>two</b><p>Three</body></html>"), (2, None, None), (2, None, None)]
    source = warc.responses(spark.createDataFrame(rows, "page_id long, url string, html string"))
    derived = warc.derive(source)
    got = derived.collect()
    by = {r.record_id: r for r in source.collect()}
    assert len(got) == 6 and {r.type for r in got} == {"metadata", "conversion"}
    for r in got:
        response = by[r.refers_to]
        assert r.source_digest == warc.digest(response.payload) and r.target_uri == response.target_uri
        assert r.block_digest == warc.digest(r.block) and r.content_length == len(r.block)
    text = {r.page_id: bytes(r.block).decode() for r in got if r.type == "conversion"}
    assert text == {1: "T\nOne & two\nThree", 2: ""}
    meta = next(bytes(r.block).decode() for r in got if r.type == "metadata" and r.page_id == 1)
    assert "http-header: Content-Type: text/html; charset=utf-8\r\n" in meta and by[next(r.refers_to for r in got if r.page_id == 1)].record_id in meta
    # what is written reads back
    for r in warc.serialised(derived).where("page_id = 1").collect():
        top, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in top.decode().split("\r\n")[1:])
        block = rest[: int(fields["Content-Length"])]
        assert rest[len(block) :] == b"\r\n\r\n" and fields["WARC-Block-Digest"] == warc.digest(block)
    assert warc.derive(warc.responses(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


class Visible(HTMLParser):
    """All text of a page by parser events: a line for each block."""

    def __init__(self, html):
        super().__init__()
        self.lines, self.skip = [""], 0
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style")
        if tag not in ("a", "b", "i", "meta", "script", "style"):
            self.lines.append("")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style")
        if tag not in ("a", "b", "i", "meta", "script", "style"):
            self.lines.append("")

    def handle_data(self, data):
        if not self.skip:
            self.lines[-1] += data


def test_warc_of_the_table(spark, small):
    """Every record of the table against plain definitions, read back from its own bytes."""
    rows = {r.page_id: r for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    got = warc.derive(warc.responses(spark.read.parquet(f"{small}/pages.parquet"))).collect()
    assert len(got) == 2 * len(rows) == len({r.record_id for r in got})
    space = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
    for r in got:
        page = rows[r.page_id]
        payload = page.html.encode()
        source = "<urn:uuid:%s>" % uuid.uuid5(space, f"{page.page_id} {page.url} {hashlib.sha1(payload).hexdigest()}")
        fields = dict(x.split(": ", 1) for x in r.header.removesuffix("\r\n\r\n").split("\r\n")[1:])
        assert fields["WARC-Refers-To"] == r.refers_to == source and fields["WARC-Target-URI"] == page.url
        assert fields["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if r.type == "conversion":
            want = [" ".join(x.split()) for x in Visible(page.html).lines]
            assert bytes(r.block).decode() == "\n".join(x for x in want if x)
        else:
            assert f"http-header: Content-Length: {len(payload)}\r\n" in bytes(r.block).decode()


def test_warc_rows(spark):
    """Pages of one address differ by their content; whole repeats are one record; other columns don't matter."""
    rows = [(1, "u", "<p>a", 5), (1, "u", "<p>b", 5), (1, "u", "<p>b", 6), (None, "u\r\nX: y", "", 7), (3, None, "x" * 2_000_000, 8)]
    got = warc.derive(warc.responses(spark.createDataFrame(rows, "page_id long, url string, html string, date int"))).collect()
    assert len(got) == 10 and len({r.record_id for r in got}) == 8 and len({r.refers_to for r in got}) == 4
    assert all(r.header.count("\r\nX: y") == 0 for r in got)
    assert max(r.content_length for r in got) == 2_000_000


def test_classifier(spark, small, docs, texts):
    folder = small.replace("0.001", "0.01")
    rows = quality_classifier.quality_classifier(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    known = rows.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").collect()
    good, bad = ([r.score for r in known if r.quality == q] for q in (1, 0))
    auc = sum((g > b) + (g == b) / 2 for g in good for b in bad) / len(good) / len(bad)
    assert auc > 0.9
    assert sum(r.predicted == r.quality for r in known) >= 0.9 * len(known)
    none = quality_classifier.quality_classifier(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert len(none) == len(texts) and all(r.score == 0.5 and r.predicted == 1 for r in none)


def test_classifier_slopes():
    """The slopes of the loss against finite differences."""
    import numpy as np

    rng = np.random.default_rng(3)
    table, layer, bias = rng.normal(size=(9, 4)), rng.normal(size=(2, 4)), rng.normal(size=2)
    ids, share = np.array([1, 4, 7]), np.array([0.5, 0.3, 0.2])

    def loss(label):
        z = layer @ (share @ table[ids]) + bias
        return float(np.log(np.exp(z).sum()) - z[label])

    for label in (0, 1):
        by_vectors, by_layer, by_bias = quality_classifier.slopes(table, layer, bias, ids, share, label)
        for values, found, at in ((table, by_vectors, [((int(i), d), (k, d)) for k, i in enumerate(ids) for d in range(4)]), (layer, by_layer, [((c, d), (c, d)) for c in range(2) for d in range(4)]), (bias, by_bias, [((c,), (c,)) for c in range(2)])):
            for where, own in at:
                was = values[where]
                values[where] = was + 1e-6
                up = loss(label)
                values[where] = was - 1e-6
                down = loss(label)
                values[where] = was
                assert abs((up - down) / 2e-6 - found[own]) < 1e-6


def test_classifier_scores_one_by_one(spark, texts):
    """Scores against a plain average for each document."""
    import numpy as np

    s = quality_classifier.Settings()
    adds = np.random.default_rng(5).normal(size=s.buckets)
    rows = [*texts, (None, "no id here here"), (3, "one")]
    docs = spark.createDataFrame([(d, t, "x", 0.5) for d, t in rows], "doc_id long, text string, held_out string, score double").repartition(3)
    got = quality_classifier.score(docs, adds, 0.25, s).collect()
    want = []
    for d, t in rows:
        found = (t or "").encode().split()
        values = [adds[b] for w in found for b in quality_classifier.subwords([w], s)[0]]
        values += [adds[quality_classifier.repeat_mark(s)]] * sum(a == b for a, b in zip(found, found[1:]))
        want.append((d, 1 / (1 + np.exp(-(np.mean(values) if values else 0.0) - 0.25))))
    assert len(got) == len(want)
    for (a, x), (b, y) in zip(sorted(((r.doc_id is None, r.doc_id or 0), r.score) for r in got), sorted(((d is None, d or 0), float(y)) for d, y in want)):
        assert a == b and abs(x - y) < 1e-9
    none = quality_classifier.quality_classifier(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).where("doc_id is null").collect()
    assert [r.held_out for r in none] == [True]


def test_rules_are_native(docs, spark, texts):
    """No Python runs in the plan of the rules; what they learn covers, grows and prunes as a plain version does."""
    labels = spark.createDataFrame([(d, int(d % 3 > 0), 0) for d, _ in texts], "doc_id long, quality int, toxic int")
    plan = quality_rules.quality_rules(docs, labels)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan.replace("ArrowColumnar", ""))


def test_held_out(docs):
    import zlib

    rows = quality_classifier.quality_classifier(docs, docs.select("doc_id", F.lit(1).alias("quality"))).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
