"""Best-fit packing of tokenised documents, improved by swaps.

Documents become pieces of at most `capacity` tokens. Pieces are dealt by a hash into groups of bounded size and
each group is packed on its own: best-fit decreasing gives the first bins, then local search over the underfull
bins moves a piece or two, or exchanges one or two for one, as long as that raises the sum of squared fills and a
bin can be spared. The open bins are indexed by piece length and room. A group loses at most its last, partly filled bins.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_texts, materialize, parts
from .word_ids import word_ids


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32. Null text counts as empty: only the end id."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, end, step = word_ids(tokenizer_path), end_id.to_bytes(4, "little"), 4 * capacity
        for batch in parts(batches):
            rows = []
            for doc_id, body in zip(batch.column(0).to_pylist(), ids.of(binary_texts(batch.column(1))), strict=True):
                whole = body + end
                for k, at in enumerate(range(0, len(whole), step)):
                    part = whole[at : at + step]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: each piece goes to the fullest bin with room. Bins hold indexes into `lengths`."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms: list[int] = []  # rooms that have a bin, ascending
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        at = bisect_left(rooms, lengths[i])
        if at == len(rooms):
            bins.append([i])
            b, room = len(bins) - 1, capacity - lengths[i]
        else:
            was = rooms[at]
            b = by_room[was].pop()
            if not by_room[was]:
                rooms.pop(at)
            bins[b].append(i)
            room = was - lengths[i]
        if room:
            if not by_room[room]:
                insort(rooms, room)
            by_room[room].append(b)
    return bins


class OpenBins:
    """Bins with room, by the lengths of their pieces (0 stands in all of them) and then by room."""

    def __init__(self, bins: list[list[int]], fill: list[int], lengths: list[int], capacity: int):
        self.bins, self.fill, self.lengths, self.capacity = bins, fill, lengths, capacity
        self.of: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
        for b, total in enumerate(fill):
            if 0 < total < capacity:
                for size in self._sizes(b):
                    self.of[size].append((capacity - total, b))
        for rooms in self.of:
            rooms.sort()
        #: The most that a bin can hold of other pieces in place of one of this length.
        self.reach = np.array([size + rooms[-1][0] if rooms else 0 for size, rooms in enumerate(self.of)])

    def _sizes(self, b: int) -> set[int]:
        return {0, *(self.lengths[i] for i in self.bins[b])}

    def drop(self, b: int) -> None:
        for size in self._sizes(b):
            rooms = self.of[size]
            rooms.pop(bisect_left(rooms, (self.capacity - self.fill[b], b)))
            self.reach[size] = size + rooms[-1][0] if rooms else 0

    def put(self, b: int) -> None:
        if self.fill[b] < self.capacity:
            for size in self._sizes(b):
                insort(self.of[size], (self.capacity - self.fill[b], b))
                self.reach[size] = size + self.of[size][-1][0]

    def step(self, source: int) -> bool:
        """Carry as many tokens as one step can from `source`, which is dropped, to the fullest bin that takes them.

        One or two pieces go, for nothing or for a piece. Whichever are given, the best return is the least length
        that reaches them.
        """
        sizes = sorted(self.lengths[i] for i in self.bins[source])
        once = [x for k, x in enumerate(sizes) if not k or x != sizes[k - 1]]
        twice = [x for k, x in enumerate(sizes) if k and x == sizes[k - 1]]
        one = np.array(once)
        given = np.unique(np.concatenate([one, (one[:, None] + one)[np.triu_indices(len(one), 1)], 2 * np.array(twice, one.dtype)]))
        given = given[given <= self.capacity]
        taken = np.searchsorted(np.maximum.accumulate(self.reach), given)
        at = int((given - taken).argmax())
        total, take = int(given[at]), int(taken[at])
        gain = total - take
        if gain <= 0:
            return False
        rooms = self.of[take]
        target = rooms[bisect_left(rooms, (gain, -1))][1]
        have = set(sizes)
        first = total if total in have else next(x for x in once if total - x in have and (total != 2 * x or x in twice))
        self.drop(target)
        for size, here, there in ((first, source, target), (total - first, source, target), (take, target, source)):
            if size:
                i = next(i for i in self.bins[here] if self.lengths[i] == size)
                self.bins[here].remove(i)
                self.bins[there].append(i)
        self.fill[source] -= gain
        self.fill[target] += gain
        self.put(target)
        return True


def improve(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Local search: empty the least filled bins by moves and exchanges that raise the sum of squared fills.

    Every step takes tokens from the least filled bin of those left to a fuller one, so squared fill grows and the
    search ends: when no step gains, or when the open bins have less room than a bin, so that none can be spared.
    """
    fill = [sum(lengths[i] for i in b) for b in bins]
    changed = True
    while changed:
        changed = False
        left = OpenBins(bins, fill, lengths, capacity)
        room = sum(r for r, _ in left.of[0])
        while left.of[0] and room >= capacity:
            source = left.of[0][-1][1]
            left.drop(source)
            while bins[source] and left.step(source):
                changed = True
            room -= 0 if bins[source] else capacity
    return [b for b in bins if b]


def pack(found: DataFrame, capacity: int = 2048, group_rows: int = 40_000) -> DataFrame:
    """Give each piece a sequence_id and an offset; other columns stay.

    `group_rows`: pieces packed together, about. Whole pieces are sequences of their own and need no packing.
    """
    found = materialize(found, "pieces")
    full = found.where(F.col("length") >= capacity)
    rest = found.where(F.col("length") < capacity)
    # pandas would turn a long column with nulls into floating point
    rest = rest.withColumns({"nameless": F.col("doc_id").isNull(), "doc_id": F.coalesce("doc_id", F.lit(0).cast("long"))})
    groups = max(1, round(rest.count() / group_rows))

    def fit(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["doc_id", "piece"], kind="stable").reset_index(drop=True)
        lengths = part["length"].tolist()
        sequence, offset = [0] * len(lengths), [0] * len(lengths)
        for b, members in enumerate(improve(best_fit(lengths, capacity), lengths, capacity)):
            at = 0
            for i in members:
                sequence[i], offset[i] = (key[0] << 32) + b, at
                at += lengths[i]
        return part.drop(columns="part").assign(sequence_id=sequence, offset=offset)

    names = found.columns
    schema = ", ".join(f"{n} {t}" for n, t in found.dtypes) + ", nameless boolean, sequence_id long, offset long"
    packed = rest.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups))).groupBy("part").applyInPandas(fit, schema)
    packed = packed.withColumn("doc_id", F.when(~F.col("nameless"), F.col("doc_id")))
    alone = full.withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return packed.select(*names, "sequence_id", "offset").unionByName(alone)


def best_fit_packing(docs: DataFrame, tokenizer_path: str, capacity: int = 2048) -> DataFrame:
    """Pack all documents; one row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids without special tokens, then id 0; null or empty text is id 0 alone. Only documents
    longer than `capacity` are cut. Rows that repeat a doc_id are packed one by one. Pieces of full length are
    their own sequences, with negative numbers. An empty table gives an empty result.
    """
    return pack(pieces(docs, tokenizer_path, capacity), capacity)
