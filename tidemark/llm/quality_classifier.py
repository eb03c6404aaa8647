"""Quality classifier of supervised subword embeddings.

A document is the average of learned vectors: one for each word and one for each character n-gram of it, all
hashed into one table; a word that repeats the one before it adds a mark of its own. A softmax layer reads the
average. Table and layer are trained together by stochastic gradient descent in numpy.
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_texts


#: Odd numbers that spread the hashes of n-grams.
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class Settings:
    buckets: int = 2**15
    dim: int = 8
    shortest: int = 2
    longest: int = 4
    epochs: int = 30
    rate: float = 4.0
    #: Most labelled documents to learn from: those whose ids hash lowest.
    train_docs: int = 2000


def subwords(words: list[bytes], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words (UTF-8) and of the n-grams of each `<word>`, and beside each the word's place in the list."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # no word holds a line feed, so one ends each of them
    text = (b"<" + b">\n<".join(words) + b">\n").decode("utf-8", "replace")
    points = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)
    ends = np.flatnonzero(points == 10)
    owner = np.repeat(np.arange(len(words)), np.diff(ends, prepend=-1))
    left = ends[owner] - np.arange(len(points))
    buckets = [np.array([xxhash.xxh64_intdigest(w, seed=1) % s.buckets for w in words], np.int64)]
    owners = [np.arange(len(words))]
    rolled = points
    for n in range(2, s.longest + 1):
        rolled = rolled[: len(points) - n + 1] * _STEP + points[n - 1 :]
        if n >= s.shortest:
            at = np.flatnonzero(left[: len(rolled)] >= n)
            mixed = (rolled[at] + np.uint64(n)) * _MIX
            buckets.append(((mixed ^ (mixed >> np.uint64(31))) % np.uint64(s.buckets)).astype(np.int64))
            owners.append(owner[at])
    return np.concatenate(buckets), np.concatenate(owners)


def repeat_mark(s: Settings) -> int:
    return xxhash.xxh64_intdigest(b"repeat", seed=2) % s.buckets


def repeats(found: list[bytes]) -> int:
    return sum(map(operator.eq, found, found[1:]))


def _features(docs: DataFrame, s: Settings) -> DataFrame:
    """doc_id, label and the bucket counts of each document, as packed arrays."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts = [], []
            for text in binary_texts(batch.column(2)):
                found = text.split()
                times = Counter(found)
                buckets, owner = subwords(list(times), s)
                total = np.bincount(buckets, np.fromiter(times.values(), np.float64, len(times))[owner], minlength=s.buckets)
                total[repeat_mark(s)] += repeats(found)
                at = np.flatnonzero(total)
                ids.append(at.astype("<i4").tobytes())
                counts.append(total[at].astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())], ["doc_id", "label", "ids", "counts"])

    return docs.select("doc_id", "label", "text").mapInArrow(count, "doc_id long, label int, ids binary, counts binary")


def slopes(table: np.ndarray, layer: np.ndarray, bias: np.ndarray, ids: np.ndarray, share: np.ndarray, label: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slopes of a document's loss, the negative log of the softmax of its label: by vectors of its buckets, layer and bias."""
    hidden = share @ table[ids] if len(ids) else np.zeros(table.shape[1])
    z = layer @ hidden + bias
    p = np.exp(z - z.max())
    p /= p.sum()
    p[label] -= 1
    return np.outer(share, p @ layer), np.outer(p, hidden), p


def _descend(rows: list[tuple[np.ndarray, np.ndarray, int]], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of the buckets and the two rows of the softmax layer."""
    rng = np.random.default_rng(7)
    table = rng.uniform(-1 / s.dim, 1 / s.dim, (s.buckets, s.dim)).astype(np.float64)
    layer = np.zeros((2, s.dim))
    bias = np.zeros(2)
    steps, done = max(1, s.epochs * len(rows)), 0
    for _ in range(s.epochs):
        for k in rng.permutation(len(rows)):
            ids, share, label = rows[k]
            rate = s.rate * (1 - done / steps)
            done += 1
            by_vectors, by_layer, by_bias = slopes(table, layer, bias, ids, share, label)
            layer -= rate * 0.1 * by_layer
            bias -= rate * 0.01 * by_bias
            if len(ids):
                table[ids] -= rate * by_vectors
    return table, np.vstack([layer.T, bias])


def train(docs: DataFrame, labels: DataFrame, s: Settings) -> tuple[np.ndarray, float]:
    """Log-odds of label 1 that each bucket adds, and the constant; learned in one task from a bounded sample.

    Only rows whose crc32 of doc_id as text isn't divisible by 5 teach.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).where("doc_id is not null and label in (0, 1) and crc32(cast(doc_id as string)) % 5 <> 0")
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"))
    taken = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.train_docs)
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(taken), "doc_id")

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("doc_id", kind="stable")
        rows = []
        for ids, counts, label in zip(part["ids"], part["counts"], part["label"], strict=True):
            n = np.frombuffer(counts, "<f4").astype(np.float64)
            rows.append((np.frombuffer(ids, "<i4"), n / n.sum() if n.size else n, int(label)))
        table, layer = _descend(rows, s)
        # the softmax of two classes needs only the difference of their scores, which is linear in the average
        return pd.DataFrame({"adds": [(table @ (layer[:-1, 1] - layer[:-1, 0])).astype("<f8").tobytes()], "constant": [float(layer[-1, 1] - layer[-1, 0])]})

    model = _features(sample, s).groupBy(F.lit("all").alias("whole")).applyInPandas(fit, "adds binary, constant double").first()
    if model is None:
        return np.zeros(s.buckets), 0.0
    return np.frombuffer(model["adds"], "<f8"), model["constant"]


def _groups(texts: list[bytes], most: int) -> Iterator[list[bytes]]:
    """All texts in order, in lists of at most so many bytes; a longer text comes alone."""
    group, held = [], 0
    for text in texts:
        if group and held + len(text) > most:
            yield group
            group, held = [], 0
        group.append(text)
        held += len(text)
    if group:
        yield group


def score(docs: DataFrame, adds: np.ndarray, constant: float, s: Settings) -> DataFrame:
    """doc_id and score of each whole text: the softmax for label 1 of the average of its vectors."""
    mark = float(adds[repeat_mark(s)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        room = 300_000
        sums, sizes = np.zeros(room), np.zeros(room)
        for batch in batches:
            scores = []
            for group in _groups(binary_texts(batch.column(1)), 2**20):
                found = [text.split() for text in group]
                flat = list(chain.from_iterable(found))
                index = np.repeat(np.arange(len(group)), [len(f) for f in found])
                total, size = np.zeros(len(group)), np.zeros(len(group))
                for at in range(0, len(flat), 100_000):
                    part = flat[at : at + 100_000]
                    if len(known) + len(part) > room:
                        known.clear()
                    new = list(set(part).difference(known))
                    buckets, owner = subwords(new, s)
                    k = slice(len(known), len(known) + len(new))
                    sums[k], sizes[k] = np.bincount(owner, adds[buckets], minlength=len(new)), np.bincount(owner, minlength=len(new))
                    known.update(zip(new, range(k.start, k.stop), strict=True))
                    word, doc = np.fromiter(map(known.__getitem__, part), np.int64, len(part)), index[at : at + len(part)]
                    total += np.bincount(doc, sums[word], minlength=len(group))
                    size += np.bincount(doc, sizes[word], minlength=len(group))
                n = np.array([repeats(f) for f in found])
                average = np.where(size > 0, (total + n * mark) / np.maximum(size + n, 1), 0.0)
                # rounded, so that how texts fall into groups doesn't show
                scores += np.round(1 / (1 + np.exp(-np.clip(average + constant, -50, 50))), 12).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def quality_classifier(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), threshold: float = 0.3) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Score: 0 to 1, higher where label 1 is likelier; from the whole text alone. Null or empty text gets the
    constant's score; so does every text if no label can be learned from. Repeated rows are scored one by one. A row
    without doc_id has no label to learn from, so it counts as held out. An empty table gives an empty result; other
    columns are ignored.
    """
    adds, constant = train(docs, labels, settings)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True)).alias("held_out")
    return score(docs, adds, constant, settings).select("doc_id", held, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
