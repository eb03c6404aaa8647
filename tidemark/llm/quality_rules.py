"""Learned decision lists of quality rules, in DataFrame functions only.

Statistics of labelled documents are cut at quantiles into codes and counted. Sequential covering reads those
counts: a rule is a conjunction of thresholds, grown by FOIL gain on two thirds of the labelled rows and pruned on
the last third; rows that it covers leave, and the next rule is grown on the rest. The list is emitted as one
ordered CASE expression, so applying it stays inside Spark.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_RUN, words

#: Ratios that rules may test, made of the columns of `statistics`.
FEATURES = {
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "bang_share": "n_bangs / greatest(word_chars, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "distinct_share": "n_distinct_words / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
}


def _let(value: Column, body) -> Column:
    """`body(value)` with the value computed once, however often the body reads it."""
    return F.transform(F.array(value), body)[0]


def _covered(w: Column, size: int) -> Column:
    """Words inside windows of `size` words that the array `w` holds twice or more."""

    def repeated(s: Column) -> Column:
        def same(i: Column, j: Column) -> Column:
            # equal hashes, then equal words
            return (s[i]["h"] == s[j]["h"]) & (F.slice(w, s[i]["p"] + 1, size) == F.slice(w, s[j]["p"] + 1, size))

        last = F.size(s) - 1
        hits = F.filter(F.sequence(F.lit(0), last), lambda i: F.when(i > 0, same(i, F.greatest(i - 1, F.lit(0)))).otherwise(False) | F.when(i < last, same(i, F.least(i + 1, last))).otherwise(False))
        return F.array_sort(F.transform(hits, lambda i: s[i]["p"]))

    def spread(p: Column) -> Column:
        steps = F.transform(p, lambda x, i: F.when(i == 0, F.lit(size)).otherwise(F.least(F.lit(size), x - p[F.greatest(i - 1, F.lit(0))])))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def count(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_let(ordered, lambda s: _let(repeated(s), spread)))

    windows = F.transform(F.sequence(F.lit(1), F.size(w) - (size - 1)), lambda i: F.xxhash64(F.slice(w, i, size)))
    return F.when(F.size(w) > size, _let(windows, count)).otherwise(F.lit(0))


def _chars(text: Column, kept: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{kept}]+", ""))


#: Counts of a text.
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct_words", "n_lines", "n_upper", "n_bangs"]


def counts_of(docs: DataFrame) -> DataFrame:
    """`docs` with the counts of each whole text in a struct `c`; null counts as a text without words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_words = _let(words(text), lambda w: F.struct(F.size(w).alias("n_words"), F.size(F.array_distinct(w)).alias("n_distinct_words"), _covered(w, 8).alias("n_repeat_words")))
    of_lines = _let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    both = docs.select("*", of_words.alias("w"), of_lines.alias("l"))
    found = {
        "word_chars": F.length(F.regexp_replace(text, SPACE_RUN, "")),
        "n_symbols": _chars(text, r"#*$%&|<>"),
        "n_upper": _chars(text, r"\p{Lu}"),
        "n_bangs": _chars(text, "!"),
        **{x: F.col(f"w.{x}") for x in ("n_words", "n_distinct_words", "n_repeat_words")},
        **{x: F.col(f"l.{x}") for x in ("n_lines", "n_dup_lines")},
    }
    return both.select(*docs.columns, F.struct(*(found[x].cast("long").alias(x) for x in COUNTS)).alias("c"))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of each whole text."""
    return counts_of(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("doc_id", "c.*")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    cut: float

    def expr(self) -> Column:
        value = F.expr(FEATURES[self.feature])
        return value > F.lit(self.cut) if self.above else value <= F.lit(self.cut)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:.6g}"


def learn(labelled: DataFrame, cuts: int = 24, precision: float = 0.95, least: int = 5, rules: int = 12) -> list[list[Test]]:
    """Ordered rules that reject label 0; `labelled` has the columns of `statistics` and `label`.

    Its size must be bounded by the caller: what reaches the driver is at most one count per labelled row.
    """
    values = labelled.select("doc_id", "label", *(F.expr(e).alias(f) for f, e in FEATURES.items()))
    shares = [(k + 0.5) / cuts for k in range(cuts)]
    edges = values.agg(*(F.percentile(f, F.array(*map(F.lit, shares))).alias(f) for f in FEATURES)).first()
    edges = {f: sorted(set(edges[f] or [])) for f in FEATURES}
    code = [sum([(F.col(f) > F.lit(e)).cast("int") for e in edges[f]], F.lit(0)).alias(f) for f in FEATURES]
    pruning = (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("pruning")
    counted = values.select("label", pruning, *code).groupBy("label", "pruning", *FEATURES).count().collect()
    names = list(FEATURES)
    rows = [(tuple(r[f] for f in names), r["label"] == 0, r["pruning"], r["count"]) for r in sorted(counted, key=str)]
    return [[Test(names[f], above, edges[names[f]][k]) for f, above, k in rule] for rule in _cover(rows, [len(edges[f]) for f in names], precision, least, rules)]


def _holds(codes: tuple, rule: list) -> bool:
    # a value above edge k has a code over k
    return all((codes[f] > k) == above for f, above, k in rule)


def _totals(rows: list, rule: list) -> tuple[int, int]:
    bad = good = 0
    for codes, is_bad, _, n in rows:
        if _holds(codes, rule):
            bad, good = (bad + n, good) if is_bad else (bad, good + n)
    return bad, good


def _cover(rows: list, edges: list[int], precision: float, least: int, most: int) -> list[list]:
    found: list[list] = []
    while len(found) < most:
        grow, prune = [r for r in rows if not r[2]], [r for r in rows if r[2]]
        rule = _grow(grow, edges)
        # drop last tests while that doesn't harm what the pruning rows say
        worth = lambda r: (lambda p, n: (p - n) / (p + n) if p + n else -1.0)(*_totals(prune, r))
        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        bad, good = _totals(rows, rule)
        held = _totals(prune, rule)
        if not rule or bad < least or bad < precision * (bad + good) or held[0] < precision * sum(held):
            break
        found.append(rule)
        rows = [r for r in rows if not _holds(r[0], rule)]
    return found


def _grow(rows: list, edges: list[int]) -> list:
    rule: list = []
    while True:
        rows = [r for r in rows if _holds(r[0], rule)]
        p0, n0 = _totals(rows, [])
        if not p0 or not n0 or len(rule) == 4:
            return rule
        best, gain = None, 1e-9
        for f, size in enumerate(edges):
            by: dict[int, list[int]] = {}
            for codes, is_bad, _, n in rows:
                by.setdefault(codes[f], [0, 0])[not is_bad] += n
            p = n = 0
            for k in range(size):
                p, n = (x + y for x, y in zip((p, n), by.get(k, (0, 0)), strict=True))
                for above, (a, b) in ((False, (p, n)), (True, (p0 - p, n0 - n))):
                    if a and (now := a * (math.log2(a / (a + b)) - math.log2(p0 / (p0 + n0)))) > gain:
                        best, gain = (f, above, k), now
        if best is None:
            return rule
        rule = [*rule, best]


def verdict(rules: list[list[Test]]) -> tuple[Column, Column]:
    """Number of the first rule that rejects a row (null if none), and whether the row stays."""
    first = F.lit(None).cast("int")
    if rules:
        chain = F
        for k, rule in enumerate(rules, 1):
            holds = rule[0].expr()
            for test in rule[1:]:
                holds &= test.expr()
            chain = chain.when(holds, F.lit(k))
        first = chain
    return first, first.isNull()


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """Statistics and label of at most `most` labelled documents, those whose ids hash lowest."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).where("doc_id is not null and label is not null")
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"))
    taken = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return statistics(docs.select("doc_id", "text").join(F.broadcast(taken.select("doc_id")), "doc_id", "left_semi")).join(F.broadcast(taken), "doc_id")


def judged(docs: DataFrame, labels: DataFrame, train_rows: int) -> DataFrame:
    """`docs` with `base_failed`, `kept`, `rule` and the counts, in a struct named `c`."""
    first, stays = verdict(learn(labelled_sample(docs, labels, train_rows)))
    failed = F.coalesce(base_failed(), F.lit(True))
    # the rules read fields of c by their bare names
    counted = counts_of(docs)
    flat = counted.select("*", "c.*")
    return flat.select(*counted.columns, *COUNTS, failed.alias("base_failed"), (~failed & stays).alias("kept"), first.alias("rule"))


def quality_rules(docs: DataFrame, labels: DataFrame, train_rows: int = 6000) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rule.

    A document stays if it passes the base rules (20 words at least, at most 30 % of them in repeated 8-word
    windows) and no learned rule rejects it; `rule` is the number of the first one that does. Rules are learned
    from at most `train_rows` labelled documents (the broadcast ids are no more). Null text has no words. Without
    labels there are no learned rules. Repeated rows are judged one by one; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return judged(docs, labels, train_rows).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def kept_documents(docs: DataFrame, labels: DataFrame, train_rows: int = 6000) -> DataFrame:
    """The rows of `docs` that stay, with their own columns; nothing is shuffled."""
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return judged(whole, labels, train_rows).where("kept").select("row.*")
