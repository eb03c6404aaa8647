"""Token ids as binary files: canonical Huffman code of limited length, blocks that decode on their own.

The code's lengths come from the counts of all ids (package-merge gives the best ones up to `LIMIT` bits); the canonical
rule turns lengths into codes, so lengths alone are stored. Documents are sorted by doc_id over all files.

Format, all numbers little-endian. A dataset is two folders of files that hold records; a record ends with one byte
0x0A, which its length doesn't count.

* `code`: one record, `TMHC`, longest code u8, number of ids u32, then the length of each id's code, u8, 0 for ids that
  don't occur.
* `data`: one file for each range of doc_ids. A record is one block of at most `BLOCK` ids:
  `TMHB`, length of the record u32, number of the file u32 (files ascend as their doc_ids do), ids of the file before this
  block u64, ids u32, spans u32, checkpoints u32; then for each span (a document, or its part in this block) doc_id i64,
  ids u32 and flags u8 (1: begins here, 2: ends here, 4: has no doc_id); then the bit offset u32 of every `STEP`-th id;
  then the codes, first bit highest, filled up with zeros to a whole byte.

Checkpoints let a reader begin at any STEP-th id. `decode` begins at all of them at once: one step reads the next id of every
checkpoint through a table that the next `LIMIT` bits index.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import binary_texts, discard, materialize, new_folder, parts, remove_folder, settings, WRITING
from .word_ids import word_ids

LIMIT, BLOCK, STEP = 20, 1 << 16, 256
CODE, HEAD, SPAN = struct.Struct("<4sBI"), struct.Struct("<4sIIQIII"), np.dtype([("doc_id", "<i8"), ("n", "<u4"), ("flags", "u1")])
BEGINS, ENDS, NAMELESS = 1, 2, 4
FILE_BYTES = 64 << 20


def token_ids(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """doc_id, ids (little-endian, of 16 bits if all fit, else 32) and their crc32 as 32-bit ids. Null text: the end id alone."""
    width = id_width(tokenizer_path, end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, end = word_ids(tokenizer_path), end_id.to_bytes(4, "little")
        for batch in parts(batches):
            bodies = [body + end for body in ids.of(binary_texts(batch.column(1)))]
            crc = pa.array(map(zlib.crc32, bodies), pa.int64())
            if width == 2:
                bodies = [np.frombuffer(b, "<u4").astype("<u2").tobytes() for b in bodies]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bodies, pa.binary()), crc], ["doc_id", "ids", "crc"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary, crc long")


def id_width(tokenizer_path: str, end_id: int) -> int:
    from tokenizers import Tokenizer

    return 2 if max(Tokenizer.from_file(tokenizer_path).get_vocab_size(), end_id + 1) <= 1 << 16 else 4


def id_counts(ids: DataFrame, width: int) -> np.ndarray:
    """How often each id occurs in all documents: counted in each task, added up by Spark, one row an id to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in parts(batches):
            found = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), f"<u{width}"), minlength=len(total))
            found[: len(total)] += total
            total = found
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "n"])

    rows = ids.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(max((r.id for r in rows), default=-1) + 1, np.int64)
    for r in rows:
        out[r.id] = r.n
    return out


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of the best prefix code with no code above `limit` bits, by package-merge; 0 for ids without a count.

    Among equal counts the smaller id counts as rarer, so the lengths don't depend on how counts arrived.
    """
    lengths = np.zeros(len(counts), np.uint8)
    seen = np.flatnonzero(counts)
    if len(seen) > 1 << limit:
        raise ValueError(f"{len(seen)} ids have no code of {limit} bits")
    if len(seen) < 2:
        lengths[seen] = 1
        return lengths
    order = seen[np.argsort(counts[seen], kind="stable")]
    coins, packages, leaves = counts[order], np.zeros(0, np.int64), []
    for _ in range(limit):
        level = np.concatenate([coins, packages])
        by = np.argsort(level, kind="stable")
        leaves.append(by < len(coins))
        level = level[by][: len(level) // 2 * 2]
        packages = level[::2] + level[1::2]
    take = 2 * (len(order) - 1)
    for leaf in reversed(leaves):
        own = int(leaf[:take].sum())
        lengths[order[:own]] += 1
        take = 2 * (take - own)
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes of the canonical rule: shorter ones first, then smaller ids, each the one before it plus one."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    codes, code, before = np.zeros(len(lengths), np.uint32), 0, 0
    for length in np.unique(lengths[order]):
        mine = order[lengths[order] == length]
        code <<= int(length) - before
        codes[mine] = code + np.arange(len(mine))
        code, before = code + len(mine), int(length)
    return codes


def decoding_table(lengths: np.ndarray, limit: int) -> np.ndarray:
    """By the next `limit` bits: the id that they begin with, times 32, plus its code's length."""
    codes, table = canonical(lengths), np.zeros(1 << limit, np.uint64)
    order = np.flatnonzero(lengths)
    order = order[np.argsort(codes[order].astype(np.uint64) << (limit - lengths[order]).astype(np.uint64), kind="stable")]
    entries = np.repeat((order.astype(np.uint64) << np.uint64(5)) | lengths[order], 1 << (limit - lengths[order].astype(np.int64)))
    table[: len(entries)] = entries
    return table


def encode(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray, step: int = STEP) -> tuple[np.ndarray, bytes]:
    """Bit offsets of every `step`-th id, and the codes one after another."""
    size = lengths[ids].astype(np.int64)
    end = np.cumsum(size)
    at = end - size
    room = 64 - (at & 31) - size  # a code lies in one or two words of 32 bits
    both = codes[ids].astype(np.uint64) << room.astype(np.uint64)
    words, n = at >> 5, int(end[-1] + 31) // 32 + 1 if len(ids) else 0
    out = np.bincount(words, (both >> np.uint64(32)).astype(np.float64), n)  # no two codes share a bit, so sums are exact
    out[1:] += np.bincount(words, (both & np.uint64(0xFFFFFFFF)).astype(np.float64), n)[: max(0, n - 1)]
    return at[::step].astype("<u4"), out.astype(">u4").tobytes()[: int(end[-1] + 7) // 8] if len(ids) else b""


def block(file: int, before: int, ids: np.ndarray, spans: list[tuple[int | None, int, int]], codes: np.ndarray, lengths: np.ndarray) -> bytes:
    """One record of a data file."""
    offsets, bits = encode(ids, codes, lengths)
    listed = np.array([(0 if d is None else d, n, flags | (NAMELESS if d is None else 0)) for d, n, flags in spans], SPAN)
    size = HEAD.size + listed.nbytes + offsets.nbytes + len(bits)
    return HEAD.pack(b"TMHB", size, file, before, len(ids), len(spans), len(offsets)) + listed.tobytes() + offsets.tobytes() + bits


def blocks(file: int, docs: Iterator[tuple[int | None, np.ndarray]], lengths: np.ndarray, most: int = BLOCK) -> Iterator[bytes]:
    """The records of one file, for documents in their order."""
    codes, ids, spans, held, before = canonical(lengths), [], [], 0, 0
    for doc_id, own in docs:
        at = 0
        while True:
            part = own[at : at + most - held]
            spans.append((doc_id, len(part), (BEGINS if at == 0 else 0) | (ENDS if at + len(part) == len(own) else 0)))
            ids.append(part)
            held, at = held + len(part), at + len(part)
            if held == most:
                yield block(file, before, np.concatenate(ids), spans, codes, lengths)
                ids, spans, held, before = [], [], 0, before + held
            if at == len(own):
                break
    if spans:
        yield block(file, before, np.concatenate(ids), spans, codes, lengths)


def records(content: bytes) -> Iterator[tuple[tuple, np.ndarray, np.ndarray, memoryview]]:
    """Header, spans, checkpoints and bits of each record of a data file."""
    at, view = 0, memoryview(content)
    while at < len(content):
        head = HEAD.unpack_from(content, at)
        if head[0] != b"TMHB" or at + head[1] >= len(content) or content[at + head[1]] != 0x0A:
            raise ValueError(f"no block at byte {at}")
        a = at + HEAD.size
        b = a + head[5] * SPAN.itemsize
        c = b + 4 * head[6]
        yield head, np.frombuffer(content, SPAN, head[5], a), np.frombuffer(content, "<u4", head[6], b), view[c : at + head[1]]
        at += head[1] + 1


def decode(blocks_: list[tuple[int, np.ndarray, memoryview]], table: np.ndarray, limit: int, step: int = STEP) -> np.ndarray:
    """The ids of some blocks, given as number of ids, checkpoints and bits: all checkpoints go on side by side."""
    if not blocks_:
        return np.zeros(0, np.uint32)
    buffer, starts, counts = bytearray(), [], []
    for n, offsets, bits in blocks_:
        starts.append(offsets.astype(np.int64) + 8 * len(buffer))
        counts.append(np.minimum(step, n - step * np.arange(len(offsets))))
        buffer += bits
        buffer += bytes(-len(buffer) % 4)
    most = max(int(c.max(initial=0)) for c in counts)
    words = np.frombuffer(bytes(buffer) + bytes(4 * (step * limit // 32 + 4)), ">u4").astype(np.uint64)
    pairs = (words[:-1] << np.uint64(32)) | words[1:]
    at, out = np.concatenate(starts), np.empty((sum(map(len, starts)), most), np.uint32)
    shift, mask, last = np.uint64(64 - limit), np.uint64((1 << limit) - 1), len(pairs) - 1
    for k in range(most):
        found = table[(pairs[np.minimum(at >> 5, last)] >> (shift - (at & 31).astype(np.uint64))) & mask]
        out[:, k] = found >> np.uint64(5)
        at += (found & np.uint64(31)).astype(np.int64)
    return out[np.arange(most) < np.concatenate(counts)[:, None]]


def read_code(content: bytes) -> tuple[int, np.ndarray]:
    """The longest code and all lengths, from the file of the code."""
    magic, limit, n = CODE.unpack_from(content)
    if magic != b"TMHC":
        raise ValueError("not a code")
    return limit, np.frombuffer(content, np.uint8, n, CODE.size)


@lru_cache(2)
def _table(content: bytes) -> tuple[int, np.ndarray]:
    """Made once by a worker, which serves many tasks."""
    limit, lengths = read_code(content)
    return limit, decoding_table(lengths, limit)


def _write_records(df: DataFrame, path: str) -> None:
    """Binary rows as they are, a file for each partition, 0x0A after each row (Spark's text sink doesn't look at the bytes)."""
    with settings(df.sparkSession, **WRITING):
        df.select(F.col("record").cast("string")).write.option("lineSep", "\n").text(path)


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1, limit: int = LIMIT) -> None:
    """Tokenise whole texts, an end id after each, and write them to `path`/code and `path`/data by ascending doc_id.

    Rows without doc_id come first; rows of one doc_id are ordered by their number of ids and the ids' crc32, and may lie in
    several files.
    """
    spark, width = docs.sparkSession, id_width(tokenizer_path, end_id)
    ids = materialize(token_ids(docs, tokenizer_path, end_id), "token-ids")
    counts = id_counts(ids, width)
    lengths = code_lengths(counts, limit)
    code = CODE.pack(b"TMHC", limit, len(lengths)) + lengths.tobytes()
    _write_records(spark.createDataFrame([(bytearray(code),)], "record binary").coalesce(1), f"{path}/code")
    size = int((counts * lengths).sum()) // 8
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // FILE_BYTES + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ((d, np.frombuffer(b, f"<u{width}")) for batch in parts(batches) for d, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        for record in blocks(TaskContext.get().partitionId(), own, lengths):
            yield pa.RecordBatch.from_arrays([pa.array([record], pa.binary())], ["record"])

    order = ["doc_id", "n", "crc", "row"]
    keyed = ids.withColumns({"n": F.length("ids"), "row": F.monotonically_increasing_id()})  # a doc_id of very many rows is split by the others
    ranged = keyed.repartitionByRange(files, *order).sortWithinPartitions(*order)
    _write_records(ranged.select("doc_id", "ids").mapInArrow(run, "record binary"), f"{path}/data")
    discard(ids)


def read(spark: SparkSession, path: str) -> DataFrame:
    """file, start in the file, doc_id, n_tokens and ids_crc32 of each document, decoded from the files at `path`.

    A file is one row of bytes, about FILE_BYTES or a single longer document.
    """
    binary = lambda name: spark.read.format("binaryFile").load(f"{path}/{name}")
    code = next((bytes(r.content) for r in binary("code").where("length > 0").select("content").limit(1).collect()))  # one byte an id

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit, table = _table(code)
        for batch in batches:
            for content in batch.column(0):
                yield from documents(content.as_py(), limit, table)

    return binary("data").where("length > 0").select("content").mapInArrow(run, "file int, start long, doc_id long, n_tokens long, ids_crc32 long")


def documents(content: bytes, limit: int, table: np.ndarray, together: int = 32) -> Iterator[pa.RecordBatch]:
    """The documents of one data file; `together` blocks are decoded at a time."""
    begun, n, crc, waiting = 0, 0, 0, []

    def rows() -> Iterator[tuple]:
        nonlocal begun, n, crc
        body, at = memoryview(decode([(head[4], offsets, bits) for head, _, offsets, bits in waiting], table, limit).astype("<u4").tobytes()), 0
        for head, spans, *_ in waiting:
            start = head[3]
            for doc_id, own, flags in spans.tolist():
                if flags & BEGINS:
                    begun, n, crc = start, 0, 0
                n, crc = n + own, zlib.crc32(body[4 * at : 4 * (at + own)], crc)
                at, start = at + own, start + own
                if flags & ENDS:
                    yield head[2], begun, None if flags & NAMELESS else doc_id, n, crc

    def batch() -> pa.RecordBatch:
        cols = list(zip(*rows(), strict=True)) or [[]] * 5
        kinds = [pa.int32(), *[pa.int64()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["file", "start", "doc_id", "n_tokens", "ids_crc32"])

    for record in records(content):
        waiting.append(record)
        if len(waiting) == together:
            yield batch()
            waiting.clear()
    if waiting:
        yield batch()


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 1, limit: int = LIMIT) -> DataFrame:
    """Write the files, read them, and place each document: doc_id, start (ids of all documents before), n_tokens, ids_crc32.

    Null and empty texts are an end id alone; a table without rows gives none. Other columns aren't read.
    """
    spark = docs.sparkSession
    path = new_folder(spark, "huffman")
    write(docs, path, tokenizer_path, end_id, limit)
    found = materialize(read(spark, path), "documents-read")
    remove_folder(spark, path)
    sizes = found.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))  # a row a file
    bases = sizes.select("file", F.coalesce(before, F.lit(0)).alias("base"))
    return found.join(bases, "file").select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")
