"""How filters interact: what each would remove at each place of each order, from decision diagrams of failure masks.

Every document gets a mask, the set of filters that it fails. Masks are counted by part in Spark; from there on a part
is at most 2^5 counted masks, whatever its size. Each part's masks become a zero-suppressed decision diagram whose
leaves carry the counts: a node asks one filter, its branches go on with the documents that pass and that fail, and a
node that nobody fails at is left out. Swapping two adjacent levels gives the next order (all 120 are reached by 119
swaps); the path on which everything passes then shows what each step removes and keeps.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import binary_texts, parts, slices

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
UPPER = bytes(range(ord("A"), ord("Z") + 1))
MARKS = b"#$%&*|"
CONTINUATION = bytes(range(0x80, 0xC0))
COUNTS = ("n", "good", "toxic")


def failures(text: bytes) -> int:
    """Bits of the filters A to D that a text fails."""
    n, distinct = 0, set()
    for part in slices(text):
        found = part.split()  # of bytes: at the word rule's white space
        n += len(found)
        distinct.update(found)
    points = len(text.translate(None, CONTINUATION))
    upper = len(text) - len(text.translate(None, UPPER))
    failed = (n < 50, 100 * len(distinct) < 65 * n, 100 * upper > 5 * points, len(text.translate(None, MARKS)) < len(text))
    return sum(1 << k for k, x in enumerate(failed) if x)


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest of the text and the mask of A to D. A null text is empty, a null source the empty part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            texts = binary_texts(batch.column(2))
            digests = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), digests, pa.array(map(failures, texts), pa.int32())], ["doc_id", "part", "digest", "mask"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), "text")
    return rows.mapInArrow(run, "doc_id long, part string, digest binary, mask int")


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask and its counts: documents, those labelled good and those labelled toxic.

    Equal texts are told by SHA-256. All of them but the rows with their smallest doc_id fail E. Rows without doc_id are
    smaller than none, so they neither fail E nor make others fail. A document with several labels is good, or toxic, if
    one of them says so.
    """
    rows = judged(docs)
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    named = rows.where("doc_id is not null").join(marks, "doc_id", "left").select("doc_id", "part", "digest", "mask", flag("good"), flag("toxic"))
    named = named.groupBy("doc_id", "digest", "part", "mask", "good", "toxic").agg(F.count("*").alias("m"))
    # copies of a text in one part and with the same labels combine before they meet the others
    groups = named.groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum("m").alias("n"), F.min(F.struct("doc_id", "m")).alias("low"))
    least = groups.groupBy("digest").agg(F.min("low.doc_id").alias("least"))
    met = groups.join(least, "digest")
    stay = F.when(F.col("low.doc_id") == F.col("least"), F.col("low.m")).otherwise(0)
    each = met.select("part", "good", "toxic", F.explode(F.array(F.struct("mask", stay.alias("n")), F.struct((F.col("mask") + COPY).alias("mask"), (F.col("n") - stay).alias("n")))).alias("x"))
    nameless = rows.where("doc_id is null").groupBy("part", "mask").agg(F.count("*").alias("n"))
    every = each.select("part", "x.mask", "x.n", "good", "toxic").unionByName(nameless.select("part", "mask", "n", F.lit(False).alias("good"), F.lit(False).alias("toxic")))
    only = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c)
    return every.where("n > 0").groupBy("part", "mask").agg(F.sum("n").alias("n"), only("good"), only("toxic"))


class Diagram:
    """Zero-suppressed diagram of counted masks under an order of filters.

    Numbers name nodes and leaves; a number stands for the same counted set of masks under every order.
    """

    EMPTY = 0

    def __init__(self, counted: dict[int, tuple[int, ...]], order: list[int]):
        self.order, width = list(order), len(next(iter(counted.values())))
        self.weight: list[np.ndarray] = [np.zeros(width, object)]
        #: filter, number of those that pass, number of those that fail; None for leaves
        self.node: list[tuple[int, int, int] | None] = [None]
        self.known: dict[tuple, int] = {}
        self.root = self._build(counted, 0)

    def _leaf(self, weight: tuple[int, ...]) -> int:
        if ("leaf", weight) not in self.known:
            self.known["leaf", weight] = len(self.node)
            self.node.append(None)
            self.weight.append(np.array(weight, object))
        return self.known["leaf", weight]

    def _build(self, counted: dict[int, tuple[int, ...]], level: int) -> int:
        if not counted:
            return self.EMPTY
        if level == len(self.order):
            return self._leaf(next(iter(counted.values())))
        bit = 1 << self.order[level]
        passed, failed = ({m: w for m, w in counted.items() if bool(m & bit) is x} for x in (False, True))
        return self._make(self.order[level], self._build(passed, level + 1), self._build(failed, level + 1))

    def _make(self, asked: int, passed: int, failed: int) -> int:
        """The node with these branches; equal ones are shared, and nobody failing needs none."""
        if failed == self.EMPTY:
            return passed
        key = (asked, passed, failed)
        if key not in self.known:
            self.known[key] = len(self.node)
            self.node.append(key)
            self.weight.append(self.weight[passed] + self.weight[failed])
        return self.known[key]

    def _parts(self, number: int, asked: int) -> tuple[int, int]:
        node = self.node[number]
        return node[1:] if node and node[0] == asked else (number, self.EMPTY)

    def swap(self, level: int) -> None:
        """Exchange the filters of a level and the next; nodes of other levels don't change."""
        x, y = self.order[level : level + 2]
        for number in [k for k, node in enumerate(self.node) if node and node[0] == x]:
            _, passed, failed = self.node[number]
            (pp, pf), (fp, ff) = self._parts(passed, y), self._parts(failed, y)
            if pf == ff == self.EMPTY:
                continue  # y isn't asked below: the node only sinks
            del self.known[self.node[number]]
            self.node[number] = (y, self._make(x, pp, fp), self._make(x, pf, ff))
            self.known[self.node[number]] = number
        self.order[level], self.order[level + 1] = y, x
        self._sweep()

    def _sweep(self) -> None:
        """Forget what the root doesn't reach, so that swaps don't visit it."""
        seen, open_ = set(), [self.root]
        while open_:
            number = open_.pop()
            if number not in seen:
                seen.add(number)
                open_ += self.node[number][1:] if self.node[number] else ()
        for number, node in enumerate(self.node):
            if node and number not in seen:
                del self.known[node]
                self.node[number] = None

    def steps(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Filter, what it removes and what is left after it, along the path on which everything passes."""
        at = self.root
        for asked in self.order:
            at, failed = self._parts(at, asked)
            yield asked, self.weight[failed], self.weight[at]


def adjacent_swaps(n: int) -> Iterator[int]:
    """Levels to swap one after another so that every order of n filters comes up once."""
    if n < 2:
        return
    turn = list(range(n - 1))  # the last filter walks through an order of the others, up and down by turns
    yield from reversed(turn)
    for k, level in enumerate(adjacent_swaps(n - 1)):
        yield level + (k % 2 == 0)
        yield from turn if k % 2 == 0 else reversed(turn)


def orders_of(counted: dict[int, tuple[int, ...]]) -> list[tuple]:
    """filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley of one part."""
    n = len(FILTERS)
    diagram = Diagram(counted, list(range(n)))
    fails = [sum(w[0] for m, w in counted.items() if m >> k & 1) for k in range(n)]
    alone = [counted.get(1 << k, (0,))[0] for k in range(n)]
    found, total = [], [0] * n

    def note() -> None:
        name = "".join(FILTERS[k] for k in diagram.order)
        for step, (k, removed, kept) in enumerate(diagram.steps(), 1):
            found.append((k, name, step, kept[0], removed))
            total[k] += removed[0]

    note()
    for level in adjacent_swaps(n):
        diagram.swap(level)
        note()
    return [(name, step, kept, r[0], fails[k] - r[0], alone[k], r[1], r[2], total[k]) for k, name, step, kept, r in found]


RESULT = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def interactions(counted: DataFrame) -> DataFrame:
    """The rows of all orders for each part of counted masks; a part's masks are one row of at most 32 entries."""
    whole = counted.groupBy("part").agg(F.collect_list(F.struct("mask", *COUNTS)).alias("masks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 64):
            for part, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = orders_of({x["mask"]: tuple(x[c] for c in COUNTS) for x in found})
                kinds = [pa.string(), pa.int32(), *[pa.int64()] * len(RESULT)]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(rows), pa.string()), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], ["part", "filter_order", "step", *RESULT])

    return whole.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in RESULT))


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """For each part, order of filters and step, what is kept, removed and lost.

    A table without rows has no parts. Other columns of either table are not read.
    """
    return interactions(masks(docs, labels))


def _sql_permutations() -> Column | str:
    letters = ", ".join(f"('{x}')" for x in FILTERS)
    names = "abcde"
    apart = " and ".join(f"{x}.f <> {y}.f" for i, x in enumerate(names) for y in names[:i])
    return f"select {' || '.join(f'{x}.f' for x in names)} as filter_order from {', '.join(f'(values {letters}) {x}(f)' for x in names)} where {apart}"


#: The same rows in DuckDB.
SQL = rf"""
    with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words,
        min(doc_id) over (partition by coalesce(text, '')) < doc_id as copy from documents),
    marks as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by doc_id),
    f as (select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic,
        case when len(words) < 50 then 'A' else '' end || case when 100 * len(list_distinct(words)) < 65 * len(words) then 'B' else '' end
        || case when 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) then 'C' else '' end
        || case when regexp_matches(text, '[#$%&*|]') then 'D' else '' end || case when copy then 'E' else '' end as mask
        from d left join marks using (doc_id)),
    m as (select part, mask, count(*) as n, count(*) filter (where good) as good, count(*) filter (where toxic) as toxic from f group by all),
    o as ({_sql_permutations()}),
    s as (select part, filter_order, step::int as step, n, good, toxic, mask, contains(mask, filter_order[step]) as fails,
        length(translate(mask, filter_order[:step - 1], '')) < length(mask) as gone, filter_order[step] as f from m, o, range(1, 6) t(step)),
    r as (select part, filter_order, step, any_value(f) as f, coalesce(sum(n) filter (where not gone and not fails), 0)::bigint as kept, coalesce(sum(n) filter (where fails and not gone), 0)::bigint as removed,
        coalesce(sum(n) filter (where fails and gone), 0)::bigint as redundant, coalesce(sum(n) filter (where mask = f), 0)::bigint as unique_fails,
        coalesce(sum(good) filter (where fails and not gone), 0)::bigint as good_lost, coalesce(sum(toxic) filter (where fails and not gone), 0)::bigint as toxic_lost from s group by part, filter_order, step)
    select * exclude (f), (sum(removed) over (partition by part, f))::bigint as shapley from r
"""
