"""Substring dedup against a log-structured index of window fingerprints.

A window of 13 words is fingerprinted by its anchor: the hash of the 5-word run with the least hash inside it. Equal
windows have equal anchors and neighbouring windows share theirs, so a document has about one fingerprint for five
windows. Fingerprints only say where to look: words decide.

1. Index. Sorted immutable runs, tables bucketed by fingerprint, hold the documents so far: fingerprint, smallest
   doc_id, number of documents. Each batch is written as such a run and merge-joined with every earlier run, bucket by
   bucket, without a shuffle of history; the fingerprints that meet are put aside. More than `fanout` runs are compacted
   into one by the same merge. A manifest in the index's folder names the runs, so that a later job can go on.
2. Verification. The stretches of text under the fingerprints that met are brought together and compared word by word.
   A window goes if a smaller doc_id has its words. A fingerprint of many documents is dealt to several tasks: what
   has no smaller doc_id within its own task's share is compared again over all shares.
3. Removal. Each text loses the words of such windows.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import WRITING, binary_texts, chunks, discard, hashes_of, materialize, new_folder, pack_texts, parts, remove_folder, rolled, settings, unpack, word_hashes

SIZE, ANCHOR = 13, 5
#: One file for each bucket of a run is sorted, so a merge needs no sort.
MERGING = {**WRITING, "spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false"}


def anchors_of(hashes: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each stretch of windows of a text that share an anchor: its hash, the text's number, the first window, the number of windows.

    `hashes` of the words of texts that begin at `begins` (one more entry than texts).
    """
    count = len(hashes) - SIZE + 1
    if count <= 0:
        return tuple(np.empty(0, np.int64) for _ in range(4))
    grams = rolled(hashes, ANCHOR)
    place = least_places(grams, SIZE - ANCHOR + 1)
    text = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    windows = np.flatnonzero(text[:count] == text[SIZE - 1 :])  # of one text
    place, text = place[windows], text[windows]
    first = np.flatnonzero((np.diff(place, prepend=-1) != 0) | (np.diff(text, prepend=-1) != 0))
    return grams[place[first]].view(np.int64), text[first], windows[first] - begins[text[first]], np.diff(np.append(first, len(place)))


def least_places(values: np.ndarray, size: int) -> np.ndarray:
    """Place of the (first) least of each `size` neighbours."""
    count = len(values) - size + 1
    best, at = values[:count].copy(), np.arange(count)
    for k in range(1, size):
        less = values[k : k + count] < best
        best[less] = values[k : k + count][less]
        at[less] = np.flatnonzero(less) + k
    return at


def fingerprints(docs: DataFrame) -> DataFrame:
    """h, doc_id: each document's distinct fingerprints, from its whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            rows = zip(batch.column(0).to_pylist(), binary_texts(batch.column(1)), strict=True)
            for near in chunks(rows, lambda r: len(r[1]), 2 << 20):
                h, text, _, _ = anchors_of(*hashes_of([t for _, t in near]))
                order = np.lexsort((h, text))
                h, text = h[order], text[order]
                new = (np.diff(h, prepend=0) != 0) | (np.diff(text, prepend=-1) != 0)
                yield pa.RecordBatch.from_arrays([pa.array(h[new]), pa.array(np.array([i for i, _ in near], np.int64)[text[new]])], ["h", "doc_id"])

    return docs.select("doc_id", "text").mapInArrow(run, "h long, doc_id long")


class FingerprintIndex:
    """Runs of fingerprints of all batches so far: tables bucketed and sorted by h, one row for each h of a run.

    `root`: folder of the index, shared by all executors; one that has a manifest is opened again.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, fanout: int = 2):
        self.spark, self.fanout = spark, fanout
        self.root = root or new_folder(spark, "fingerprint-index")
        self.version, self.buckets, self.runs, self.compactions = 0, int(spark.conf.get("spark.sql.shuffle.partitions")), [], 0
        if root:
            self._open()

    def _open(self) -> None:
        """Read the newest manifest, if there is one."""
        try:
            found = [json.loads(r[0]) for r in self.spark.read.text(f"{self.root}/manifest-*").collect()]  # one short line for each version
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return
        newest = max(found, key=lambda m: m["version"])
        self.version, self.buckets, self.runs = newest["version"], newest["buckets"], newest["runs"]
        for name in self.runs:
            self.spark.sql(f"create table if not exists {name} (h bigint, doc_id bigint, n bigint) using parquet clustered by (h) sorted by (h) into {self.buckets} buckets location '{self.root}/{name}'")

    def _commit(self, runs: list[str]) -> None:
        """Write a manifest of these runs; then the runs that it no longer names can go."""
        self.version += 1
        line = json.dumps({"version": self.version, "buckets": self.buckets, "runs": runs})
        self.spark.range(1).coalesce(1).select(F.lit(line).alias("value")).write.text(f"{self.root}/manifest-{self.version:06d}")
        gone, self.runs = [r for r in self.runs if r not in runs], runs
        for name in gone:
            self.spark.sql(f"drop table {name}")
            remove_folder(self.spark, f"{self.root}/{name}")

    def _write(self, rows: DataFrame) -> str:
        """Write rows with one h each as a run."""
        name = f"fingerprints_{uuid.uuid4().hex}"
        with settings(self.spark, **MERGING):
            rows.write.bucketBy(self.buckets, "h").sortBy("h").format("parquet").option("path", f"{self.root}/{name}").saveAsTable(name)
        return name

    def add(self, batch: DataFrame) -> DataFrame:
        """Index a batch (h, doc_id); gives h and n (documents so far) of its fingerprints that other documents have.

        A fingerprint's rows are summed up within each task before they are shuffled.
        """
        with settings(self.spark, **{"spark.sql.shuffle.partitions": str(self.buckets)}):
            name = self._write(batch.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("top"), F.count("*").alias("n")))
        new = self.spark.table(name)
        with settings(self.spark, **MERGING):
            met = new.where("doc_id < top").select("h", "n")
            for run in self.runs:
                met = met.unionByName(new.join(self.spark.table(run).hint("merge").select("h", F.col("n").alias("more")), "h").select("h", (F.col("n") + F.col("more")).alias("n")))
            met = materialize(met, "met")
        self._commit([*self.runs, name])
        if len(self.runs) > self.fanout:
            self.compact()
        return met

    def compact(self) -> None:
        """Merge all runs into one that keeps the smallest document of each fingerprint."""
        merged = self.spark.table(self.runs[0]).select("h", "doc_id", "n")
        for run in self.runs[1:]:
            more = self.spark.table(run).select("h", F.col("doc_id").alias("other"), F.col("n").alias("more"))
            merged = merged.join(more.hint("merge"), "h", "full").select("h", F.least("doc_id", "other").alias("doc_id"), (F.coalesce("n", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n"))
        with settings(self.spark, **MERGING):
            name = self._write(merged)
        self.compactions += 1
        self._commit([name])

    def drop(self) -> None:
        """Delete the index."""
        for name in self.runs:
            self.spark.sql(f"drop table if exists {name}")
        remove_folder(self.spark, self.root)


def stretches(held: DataFrame) -> DataFrame:
    """The stretches of texts (doc_id, packed, found: array of h and shares) under fingerprints that met.

    h, share, shares, doc_id, mark (of the text), words, and the places of the first window; once for each text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 64):
            texts = unpack(batch.column(1))
            found = batch.column(2).flatten()
            wanted, dealt = (found.field(n).to_numpy() for n in ("h", "shares"))
            edges = np.append(0, np.cumsum(batch.column(2).value_lengths().to_numpy(zero_copy_only=False)))
            out: list[list] = [[] for _ in range(7)]
            for n, (doc_id, text) in enumerate(zip(batch.column(0).to_pylist(), texts, strict=True)):
                order = np.argsort(wanted[edges[n] : edges[n + 1]]) + edges[n]
                own = wanted[order]
                hashes = word_hashes(text)
                h, _, first, count = anchors_of(hashes, np.array([0, len(hashes)]))
                at = np.searchsorted(own, h)
                met = np.flatnonzero(own[np.minimum(at, len(own) - 1)] == h)
                mark, words, by = mark_of(text), text.split(), {}
                begins = first[met].tolist()
                for key, begin, end, share in zip(h[met].tolist(), begins, (first[met] + count[met] + SIZE - 1).tolist(), dealt[order[at[met]]].tolist(), strict=True):
                    by.setdefault((key, b" ".join(words[begin:end]), share), []).append(begin)
                keys, stretch, shares = zip(*by, strict=True) if by else ((), (), ())
                for column, values in zip(out, (keys, [doc_id % s for s in shares], shares, [doc_id] * len(by), [mark] * len(by), stretch, by.values()), strict=True):
                    column.extend(values)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["h", "share", "shares", "doc_id", "mark", "words", "places"])

    return held.select("doc_id", "packed", "found").mapInArrow(run, "h long, share long, shares long, doc_id long, mark long, words binary, places array<int>")


def mark_of(text: bytes) -> int:
    """Tells texts of one doc_id apart."""
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True)


def windows_of(stretch: bytes) -> list[bytes]:
    words = stretch.split(b" ")
    return [b" ".join(words[k : k + SIZE]) for k in range(len(words) - SIZE + 1)]


def compared(rows: list[tuple]) -> Iterator[tuple[int, int]]:
    """Which of a stretch's windows a smaller doc_id has, and which not, as bits; for rows (doc_id, words) by doc_id."""
    same = len({words for _, words in rows}) == 1
    whole: dict[bytes, int] = {}
    first: dict[bytes, int] = {}
    for doc_id, words in rows:
        if whole.setdefault(words, doc_id) < doc_id or same:
            every = (1 << (words.count(b" ") + 2 - SIZE)) - 1
            yield (every, 0) if whole[words] < doc_id else (0, every)
            continue
        gone = stays = 0
        for k, window in enumerate(windows_of(words)):
            if first.setdefault(window, doc_id) < doc_id:
                gone |= 1 << k
            else:
                stays |= 1 << k
        yield gone, stays


def verified(met: DataFrame) -> DataFrame:
    """doc_id, mark, places and bits of the windows that a smaller doc_id has; and stretches to compare again.

    `met` has the rows of `stretches`. A fingerprint in one share is settled here. In one of several shares, windows
    without a smaller doc_id stay open; `words` is null in all other rows.
    """
    schema = "doc_id long, mark long, places array<int>, gone int, open int, words binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            more = pa.Table.from_batches([batch])
            rest = pa.concat_tables([rest, more]) if rest is not None else more
            h, share = (rest[n].to_numpy() for n in ("h", "share"))
            ends = np.flatnonzero((h[1:] != h[:-1]) | (share[1:] != share[:-1])) + 1
            if len(ends):
                yield settled(rest.slice(0, ends[-1]), ends[:-1])
                rest = rest.slice(ends[-1])
        if rest is not None:
            yield settled(rest, np.empty(0, np.int64))

    def settled(part: pa.Table, ends: np.ndarray) -> pa.RecordBatch:
        part = part.combine_chunks()
        ids, words = part["doc_id"].to_pylist(), part["words"].to_pylist()
        gone, open_ = [], []
        for at, end in zip([0, *ends.tolist()], [*ends.tolist(), len(ids)], strict=True):
            if end - at == 1:
                gone.append(0)
                open_.append((1 << (words[at].count(b" ") + 2 - SIZE)) - 1)
                continue
            for lost, stays in compared(list(zip(ids[at:end], words[at:end], strict=True))):
                gone.append(lost)
                open_.append(stays)
        several = part["shares"].to_numpy() > 1
        open_ = np.where(several, np.array(open_, np.int32), 0).astype(np.int32)
        gone = np.array(gone, np.int32)
        columns = [part["doc_id"], part["mark"], part["places"], pa.array(gone), pa.array(open_), pa.array(words, pa.binary(), mask=open_ == 0)]
        out = pa.table(columns, names=["doc_id", "mark", "places", "gone", "open", "words"]).filter(pa.array((gone > 0) | (open_ > 0)))
        return out.combine_chunks().to_batches()[0] if len(out) else pa.RecordBatch.from_pylist([], schema=out.schema)

    return met.repartition("h", "share").sortWithinPartitions("h", "share", "doc_id").mapInArrow(run, schema)


def again(half: DataFrame) -> DataFrame:
    """What the open windows of fingerprints in several shares lose: they are compared by their words over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, mark, places, bits, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out += [(doc_id, mark, places, 1 << k, w) for k, w in enumerate(windows_of(words)) if bits >> k & 1]
            columns = zip(*out, strict=True) if out else [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "mark", "places", "gone", "window"])

    each = half.where("open > 0").select("doc_id", "mark", "places", "open", "words").mapInArrow(run, "doc_id long, mark long, places array<int>, gone int, window binary")
    low = each.groupBy("window").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("top")).where("low < top").select("window", "low")
    low = materialize(low, "open-windows")
    return each.join(low, "window").where("doc_id > low").select("doc_id", "mark", "places", "gone")


def remove(docs: DataFrame, gone: DataFrame, with_text: bool, others: tuple[str, ...]) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and text, as it was where nothing goes) of each packed row, and `others`."""
    gone = gone.groupBy("doc_id").agg(F.collect_list(F.struct("mark", "places", "gone")).alias("gone"))

    def stay(size: int, at: np.ndarray, bits: np.ndarray) -> np.ndarray:
        lost = np.zeros(size + SIZE, np.int32)
        for k in range(SIZE - ANCHOR + 1):
            begin = at[bits >> k & 1 == 1] + k
            lost[begin] += 1
            lost[begin + SIZE] -= 1
        return np.cumsum(lost)[:size] == 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            rows, lists = [], batch.column(2)
            windows = lists.flatten()
            places = windows.field("places")
            at, size = places.flatten().to_numpy(), places.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            bits, marks = (np.repeat(windows.field(n).to_numpy(), size) for n in ("gone", "mark"))
            ends = np.append(0, np.cumsum(size))[np.append(0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))]
            for text, low, high in zip(unpack(batch.column(1)), ends[:-1], ends[1:], strict=True):
                found = text.split()
                own = np.flatnonzero(marks[low:high] == mark_of(text)) + low if low < high else slice(0)
                stays = stay(len(found), at[own], bits[own])
                kept = b" ".join(found if stays.all() else [x for x, s in zip(found, stays.tolist(), strict=True) if s])
                removed = int(len(found) - stays.sum())
                rows.append((len(found), removed, hashlib.sha256(kept).hexdigest(), (kept if removed else text).decode("utf-8", "replace") if with_text else None))
            n, r, sha, out = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(sha, pa.string()), pa.array(out, pa.string()), *batch.columns[3:]], ["doc_id", "n_words", "n_removed", "kept_sha256", "text", *others])

    named = docs.where("doc_id is not null").join(gone.hint("shuffle_hash"), "doc_id", "left")
    # rows without doc_id lose nothing and need no shuffle
    rows = named.unionByName(docs.where("doc_id is null").withColumn("gone", F.lit(None).cast(gone.schema["gone"].dataType)))
    schema = StructType([*StructType.fromDDL("doc_id long, n_words long, n_removed long, kept_sha256 string, text string"), *(docs.schema[n] for n in others)])
    out = rows.select("doc_id", "packed", "gone", *others).mapInArrow(run, schema)
    return out if with_text else out.drop("text")


def substring_dedup(docs: DataFrame, batches: int = 4, share_docs: int = 1024, with_text: bool = False, others: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_removed, kept_sha256 (and text, as it was where nothing goes; and `others`).

    Each word goes that a window of 13 words covers which also starts in a document with a smaller doc_id, as the
    input has them. Documents pass the index in `batches` by ascending doc_id, about equal in number. `share_docs`: the
    rows of a fingerprint that are compared in one task, about. Null text has no words. A document that repeats a
    window only within itself keeps it. Rows that repeat a doc_id are one document's, and each loses what a smaller
    doc_id has. An empty table gives an empty result. A row without doc_id keeps all its words and takes none from
    others. `others` are columns to carry along under names that the result doesn't have yet.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *others)
    cuts = docs.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], F.lit(1000))).first()[0] or []
    number = sum(((F.col("doc_id") > c).cast("int") for c in sorted(set(cuts))), F.lit(0))
    found = materialize(fingerprints(docs.where("doc_id is not null")).withColumn("batch", number), "fingerprints")

    index = FingerprintIndex(docs.sparkSession)
    met = [index.add(found.where(F.col("batch") == k).select("h", "doc_id")) for k in range(len(set(cuts)) + 1)]
    index.drop()
    packed = pack_texts(docs, *others)
    gone = lost_windows(packed, found, met, share_docs)
    discard(found)
    return remove(packed, gone, with_text, others)


def lost_windows(packed: DataFrame, found: DataFrame, met: list[DataFrame], share_docs: int) -> DataFrame:
    """doc_id, mark, places and bits of the windows that a smaller doc_id has, for fingerprints (h, n) that met.

    `packed` has the texts of all documents with such fingerprints, `found` their fingerprints.
    """
    every = met[0]
    for more in met[1:]:
        every = every.unionByName(more)
    every = materialize(every.groupBy("h").agg(F.ceil(F.max("n") / share_docs).alias("shares")), "met")
    candidates = materialize(found.select("h", "doc_id").join(every.hint("shuffle_hash"), "h").select("doc_id", "h", "shares"), "candidates")
    held = packed.join(candidates.groupBy("doc_id").agg(F.collect_list(F.struct("h", "shares")).alias("found")).hint("shuffle_hash"), "doc_id")
    half = materialize(verified(stretches(held)), "verified")
    discard(every, candidates, *met)
    return half.where("gone > 0").select("doc_id", "mark", "places", "gone").unionByName(again(half))


def dedup_batch(index: FingerprintIndex, batch: DataFrame, history: DataFrame, share_docs: int = 1024, with_text: bool = False) -> DataFrame:
    """The result of `substring_dedup` for a new batch alone, held against an index and the texts that it covers.

    The batch's fingerprints become a run of the index. Of `history` only texts with fingerprints that met are
    compared. A document of the batch loses what smaller doc_ids of both have; earlier results don't change.
    """
    batch, history = (x.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) for x in (batch, history))
    met = index.add(fingerprints(batch.where("doc_id is not null")))
    named = batch.unionByName(history).where("doc_id is not null")
    return remove(pack_texts(batch), lost_windows(pack_texts(named), fingerprints(named), [met], share_docs), with_text, ())
