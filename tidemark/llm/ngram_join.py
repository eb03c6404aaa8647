"""N-gram Jaccard join by count vectors in R-trees.

A document is its set of 5-word shingles; documents link when 100 * shared >= 75 * united. Documents of one set are
one. Linked sets share a shingle among their first n - ceil(0.75 n) + 1 in any common order, so those prefixes,
rarest first by counts over all documents, deal documents into blocks (one per shingle that two sets share).

Shingles are hashed into groups, and the counts of the groups are a point: two sets share at most the sum of their
coordinates' minima. Every pair is bounded so before it is verified on whole sets. Members of a block are first
held against the block's smallest document; the links found make components. Blocks that still hold several
components index their points in R-trees, cut by size into chunks of bounded size, and look each member up in the
chunks whose sizes can link with its own; pairs of one component are skipped, since they can't change the result.
No link between different components is lost.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import binary_texts, chunks, discard, hashes_of, materialize, mix, pack_texts, parts, rolled, unpack
from .components import components

SHINGLE, SHARE = 5, 75
#: Counters of shingles over all documents, to order shingles rarest first. More documents make the order coarser, never wrong.
COUNTERS = 2**18
#: Members of a block in one chunk, about.
CHUNK = 512


def shingle_sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each text's shingles; fewer than five words are one shingle."""
    for part in chunks(texts, len, 1 << 20):
        w, begins = hashes_of(part, lower=True)
        runs = rolled(w, SHINGLE)
        for at, end in zip(begins.tolist(), begins.tolist()[1:]):
            n = end - at
            if n >= SHINGLE:
                yield np.unique(runs[at : end - SHINGLE + 1])
            else:
                yield mix(rolled(w[at:end], n) + np.uint64(n)) if n else np.empty(0, np.uint64)


def prefix_length(n: int) -> int:
    return n - -(-SHARE * n // 100) + 1 if n else 0


def point(s: np.ndarray) -> np.ndarray:
    """Counts of the shingles' groups; the number of groups, a power of two, follows the size of the set."""
    groups = 1 << min(10, max(5, (len(s) // 4).bit_length()))
    return np.minimum(np.bincount((s >> np.uint64(40)).astype(np.int64) & (groups - 1), minlength=groups), 65535).astype("<u2")


def folded(p: np.ndarray, groups: int) -> np.ndarray:
    return p if len(p) == groups else p.reshape(-1, groups).astype(np.int64).sum(axis=0)


def least_overlap(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Fewest shingles that sets of these sizes share when they link."""
    return -(-SHARE * (n + m) // (100 + SHARE))


class RTree:
    """Points packed by size, then by their widest coordinate; each node knows the maxima of its points."""

    def __init__(self, sizes: np.ndarray, points: np.ndarray, leaf: int = 32):
        self.sizes, self.points, self.leaf = sizes, points, leaf

    def pairs(self, nodes: np.ndarray, queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, point) numbers whose bound lets them link, for points `nodes` and queries among the points."""
        if not len(nodes) or not len(queries):
            return
        n, low, high = self.sizes[queries], self.sizes[nodes].min(), self.sizes[nodes].max()
        top = self.points[nodes].max(axis=0)
        smallest = np.maximum(low, -(-SHARE * n // 100))
        ok = (100 * high >= SHARE * n) & (SHARE * low <= 100 * n) & (np.minimum(self.points[queries], top).sum(axis=1) >= least_overlap(n, smallest))
        queries = queries[ok]
        if not len(queries):
            return
        if len(nodes) > self.leaf:
            if high > 2 * low:
                order = np.argsort(self.sizes[nodes], kind="stable")
            else:
                order = np.argsort(self.points[nodes][:, int(np.argmax(self.points[nodes].var(axis=0)))], kind="stable")
            for part in np.array_split(nodes[order], 4):
                yield from self.pairs(part, queries)
            return
        for at in range(0, len(queries), 256):
            q = queries[at : at + 256]
            n, m = self.sizes[q][:, None], self.sizes[nodes][None, :]
            shared = np.minimum(self.points[q][:, None, :], self.points[nodes][None, :, :]).sum(axis=2)
            i, j = np.nonzero((shared >= least_overlap(n, m)) & (100 * np.minimum(n, m) >= SHARE * np.maximum(n, m)))
            yield q[i], nodes[j]


def _counted(docs: DataFrame) -> DataFrame:
    """Rows of two kinds: doc_id, n, key (of the set), point for each document; bucket, hits for a task's counters."""
    names = ["doc_id", "n", "key", "point", "bucket", "hits"]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = np.zeros(COUNTERS, np.int64)
        for batch in parts(batches):
            rows = []
            for s in shingle_sets(binary_texts(batch.column(1))):
                rows.append((len(s), set_key(s), point(s).tobytes() if len(s) else None))
                np.add.at(hits, (s & np.uint64(COUNTERS - 1)).astype(np.int64), 1)
            columns = [batch.column(0), *(zip(*rows, strict=True) if rows else ((), (), ())), pa.nulls(len(rows)), pa.nulls(len(rows))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) if isinstance(c, tuple) else c.cast(t) for c, t in zip(columns, kinds, strict=True)], names)
        at = np.flatnonzero(hits)
        yield pa.RecordBatch.from_arrays([*(pa.nulls(len(at), t) for t in kinds[:4]), pa.array(at.astype(np.int32)), pa.array(hits[at])], names)

    return docs.mapInArrow(run, "doc_id long, n long, key binary, point binary, bucket int, hits long")


def set_key(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def _prefixes(docs: DataFrame, hits: np.ndarray) -> DataFrame:
    """doc_id, key and the prefix of each document that has shingles."""
    shared = docs.sparkSession.sparkContext.broadcast(hits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            ids, keys, flat, ends = [], [], [], [0]
            for doc_id, s in zip(batch.column(0).to_pylist(), shingle_sets(binary_texts(batch.column(1))), strict=True):
                if len(s):
                    # s is sorted, so ties of the count keep the order of the hashes
                    rare = np.argsort(shared.value[(s & np.uint64(COUNTERS - 1)).astype(np.int64)], kind="stable")
                    first = s[rare[: prefix_length(len(s))]]
                    ids.append(doc_id)
                    keys.append(set_key(s))
                    flat.append(first.view(np.int64))
                    ends.append(ends[-1] + len(first))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat) if flat else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), lists], ["doc_id", "key", "prefix"])

    return docs.mapInArrow(run, "doc_id long, key binary, prefix array<long>")


def _side(sets: DataFrame, end: str, *columns: str) -> DataFrame:
    return sets.select(F.col("id").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in columns))


def fits(n: np.ndarray, m: np.ndarray, a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Which sets of these sizes and packed points can link; points of like lengths are bounded together."""
    ok = 100 * np.minimum(n, m) >= SHARE * np.maximum(n, m)
    wide, other = (np.fromiter(map(len, x), np.int64, len(x)) // 2 for x in (a, b))
    for p, q in set(zip(wide[ok].tolist(), other[ok].tolist(), strict=True)):
        rows = np.flatnonzero(ok & (wide == p) & (other == q))
        for at in range(0, len(rows), 4096):
            some, groups = rows[at : at + 4096], min(p, q)
            x, y = (np.frombuffer(b"".join([raw[k] for k in some.tolist()]), "<u2").reshape(len(some), -1, groups).sum(axis=1, dtype=np.int64) for raw in (a, b))
            ok[some] = np.minimum(x, y).sum(axis=1) >= least_overlap(n[some], m[some])
    return ok


def _bounded(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """Pairs (u, v) whose sizes and points let them link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = fits(batch.column(2).to_numpy(), batch.column(3).to_numpy(), batch.column(4).to_pylist(), batch.column(5).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(keep))

    both = pairs.join(_side(points, "u", "n", "point"), "u").join(_side(points, "v", "n", "point"), "v")
    sized = both.where(f"100 * least(n_u, n_v) >= {SHARE} * greatest(n_u, n_v)")
    return sized.select("u", "v", "n_u", "n_v", "point_u", "point_v").mapInArrow(run, "u long, v long")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (u, v) that link, by the whole sets of their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for part in parts([batch], 256):
                for a, b in zip(shingle_sets(unpack(part.column(2))), shingle_sets(unpack(part.column(3))), strict=True):
                    keep.append(linked(a, b))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(_side(texts, "u", "packed"), "u").join(_side(texts, "v", "packed"), "v")
    return both.select("u", "v", "packed_u", "packed_v").mapInArrow(run, "u long, v long")


def _strata(mixed: DataFrame, points: DataFrame) -> DataFrame:
    """pivot, n, and the chunks of a block's members of that size: first, last, and from, to, those with sizes that can link.

    A block's chunks follow the sizes of its sets, a row for each size of each block; members of one size that fill
    several chunks are dealt to them by hash, so a chunk has at most about three times CHUNK members.
    """
    sizes = mixed.join(points.select("id", "n"), "id").groupBy("pivot", "n").agg(F.count("*").alias("m"))
    block = Window.partitionBy("pivot")
    before = F.coalesce(F.sum("m").over(block.orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    dealt = sizes.withColumn("before", before).select("pivot", "n", F.floor(F.col("before") / CHUNK).alias("first"), F.floor((F.col("before") + F.col("m") - 1) / CHUNK).alias("last"))
    # whole millionths of a logarithm, and a little more than the ratio, so that rounding takes no size away
    reach = math.ceil(1e6 * math.log(100 / SHARE)) + 2
    scale = block.orderBy(F.floor(1e6 * F.ln("n")))
    return dealt.withColumns({"from": F.min("first").over(scale.rangeBetween(-reach, 0)), "to": F.max("last").over(scale.rangeBetween(0, reach))})


def _candidates(mixed: DataFrame, points: DataFrame, strata: DataFrame) -> DataFrame:
    """Pairs (u, v) of different components that the bound lets through inside the blocks of `mixed` (pivot, id, component).

    A chunk of a block is a piece of its tree's first level, which is ordered by size. Each chunk's R-tree is asked for the
    partners of its own and of later chunks' members; members go only to chunks with sizes that can link with theirs.
    """
    rows = mixed.join(points, "id").join(strata, ["pivot", "n"]).withColumn("chunk", F.col("first") + F.pmod(F.xxhash64("id"), F.col("last") - F.col("first") + 1))
    rows = rows.withColumn("other", F.explode(F.sequence("from", "to"))).withColumns({"low": F.least("chunk", "other"), "high": F.greatest("chunk", "other")})
    rows = rows.select("pivot", "low", "high", "chunk", "id", "component", "n", "point").repartition("pivot", "low", "high").sortWithinPartitions("pivot", "low", "high")

    def search(part: list[tuple]) -> Iterator[tuple[int, int]]:
        sizes, chunk = (np.array([r[k] for r in part]) for k in (6, 3))
        groups = min(len(r[7]) for r in part) // 2
        tree = RTree(sizes, np.array([folded(np.frombuffer(r[7], "<u2"), groups) for r in part], np.int32))
        same = part[0][1] == part[0][2]
        nodes = np.arange(len(part)) if same else np.flatnonzero(chunk == part[0][1])
        queries = np.arange(len(part)) if same else np.flatnonzero(chunk != part[0][1])
        for i, j in tree.pairs(nodes, queries):
            some = [(x, y) for x, y in zip(i.tolist(), j.tolist(), strict=True) if not (same and x <= y) and part[x][5] != part[y][5]]
            if some:
                x, y = (np.array(z) for z in zip(*some, strict=True))
                for u, v, ok in zip(x.tolist(), y.tolist(), fits(sizes[x], sizes[y], [part[k][7] for k in x.tolist()], [part[k][7] for k in y.tolist()]).tolist(), strict=True):
                    if ok:
                        yield max(part[u][4], part[v][4]), min(part[u][4], part[v][4])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: list[tuple] = []
        for batch in batches:
            out: list = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part and row[:3] != part[0][:3]:
                    out += search(part)
                    part = []
                part.append(row)
            yield as_pairs(out)
        yield as_pairs(list(search(part)) if part else [])

    return rows.mapInArrow(run, "u long, v long").distinct()


def as_pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    u, v = zip(*found, strict=True) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= SHARE * (len(a) + len(b) - shared)


def ngram_join(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id that links reach).

    Words are lower-cased in A-Z. Null text or text without words has no shingles and links with nothing; fewer
    than five words are one shingle. A row without doc_id links with nothing and has no component_id. Rows that repeat a
    doc_id are rows of one document: each has its own n_shingles, and they share what any of them links with. An empty
    table gives an empty result; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = materialize(_counted(docs), "shingle-counts")
    members = counted.where("doc_id is not null")
    nameless = counted.where("doc_id is null and n is not null")  # rows of counters have no n
    hits = np.zeros(COUNTERS, np.int64)
    for row in counted.where("bucket is not null").groupBy("bucket").agg(F.sum("hits").alias("hits")).collect():
        hits[row["bucket"]] = row["hits"]
    points = materialize(members.where("key is not null").groupBy("key").agg(F.min(F.struct("doc_id", "n", "point")).alias("x")).select(F.col("x.doc_id").alias("id"), "x.n", "x.point"), "points")
    sets_of = members.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("id"))

    # blocks: shingles of prefixes that two sets share, with the smallest document of each. Sums by shingle combine within
    # each task, and the rows meet them in a join, which Spark splits where one shingle has very many
    distinct = materialize(_prefixes(docs.where("doc_id is not null"), hits).groupBy("key").agg(F.min("doc_id").alias("id"), F.first("prefix").alias("prefix")).select("id", "prefix"), "prefixes")
    entries = distinct.select("id", F.explode("prefix").alias("h"))
    shared = materialize(entries.groupBy("h").agg(F.min("id").alias("pivot"), F.max("id").alias("high")).where("pivot < high").select("h", "pivot"), "shared")
    entries = materialize(entries.join(shared.hint("shuffle_hash"), "h").select("id", "pivot").distinct(), "blocks")
    discard(distinct, shared)
    # texts of the documents that share a block with another
    texts = materialize(pack_texts(docs).join(entries.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi").select(F.col("doc_id").alias("id"), "packed"), "texts")

    # each member against its block's smallest document
    stars = entries.where("id > pivot").select(F.col("id").alias("u"), F.col("pivot").alias("v"))
    pairs = materialize(_bounded(stars, points), "pairs")
    links = materialize(_verified(pairs, texts), "links")
    label = components(links)

    # blocks that still hold several components; blocks with one smallest document are one
    labelled = entries.join(label.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    several = materialize(labelled.groupBy("pivot").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("pivot"), "mixed")
    mixed = materialize(labelled.join(several, "pivot").select("pivot", "id", "component"), "mixed")
    strata = materialize(_strata(mixed, points), "strata")
    discard(pairs, entries, several, label)
    others = materialize(_candidates(mixed, points, strata), "pairs")
    discard(mixed, strata, points)
    more = materialize(_verified(others, texts), "links")
    discard(others, texts)

    final = components(links.unionByName(more))
    discard(links, more)
    named = sets_of.join(final.withColumnRenamed("node", "id"), "id", "left").select("key", F.coalesce("component", "id").alias("component_id"))
    some = members.where("key is not null").join(named, "key").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    none = nameless.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return some.unionByName(none).unionByName(members.where("key is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
