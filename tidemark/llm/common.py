"""Helpers that several text operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: White space of the word rule: space and U+0009 to U+000D.
SPACE_RUN = r"[\x20\x09-\x0D]+"
SPACE_BYTE = re.compile(rb"[\x20\x09-\x0D]")
_FOLDERS: dict[str, str] = {}


def work_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Only a local session without that setting gets a temporary folder.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _FOLDERS:
        _FOLDERS[context.applicationId] = tempfile.mkdtemp(prefix="tidemark-")
    return _FOLDERS[context.applicationId]


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{work_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings that hold inside a `with` block."""
    was = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: A written step is read from its files, so the shuffles that made it can go at once.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    with settings(spark, **WRITING):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.folder = path
    return out


def remove_folder(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(*written: DataFrame) -> None:
    """Delete what `materialize` wrote, once nothing reads it any more."""
    for df in written:
        remove_folder(df.sparkSession, df.folder)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text as an array; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), "")


def parts(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches of fewer rows, so that a worker holds fewer texts at a time."""
    for batch in batches:
        for at in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(at, rows)


def binary_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null becomes empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of a text's words. A long text is read slice by slice, so only its hashes stand in memory whole."""
    return np.concatenate([np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found)) for found in map(bytes.split, slices(text))])


def hashes_of(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' words, and where each text's begin (one more entry than texts)."""
    each = [word_hashes(t.lower() if lower else t) for t in texts]  # bytes.lower changes A-Z alone
    return np.concatenate(each) if each else np.empty(0, np.uint64), np.cumsum([0, *map(len, each)])


def slices(text: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """Parts of about `size` bytes that no word crosses the ends of (a word of its own length is one part)."""
    at = 0
    while len(text) - at > size:
        space = SPACE_BYTE.search(text, at + size)
        if not space:
            break
        yield text[at : space.start()]
        at = space.start()
    yield text[at:] if at else text


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads close inputs (splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolled(hashes: np.ndarray, size: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hash of each run of `size` consecutive words, from the words' hashes."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n].copy()
    for i in range(1, size):
        out *= np.uint64(base)
        out += hashes[i : i + n]
    return mix(out)


def chunks(rows, weight, most: int):
    """Split a sequence into lists whose weights sum to about `most`."""
    part, total = [], 0
    for row in rows:
        part.append(row)
        total += weight(row)
        if total >= most:
            yield part
            part, total = [], 0
    if part:
        yield part


def pack_texts(docs: DataFrame, *others: str) -> DataFrame:
    """doc_id and the text's UTF-8, compressed for a shuffle (null as empty), and other columns as they are."""

    def run(batches):
        import zstandard

        small = zstandard.ZstdCompressor(level=3, write_checksum=False)
        for batch in parts(batches):
            packed = pa.array([small.compress(t) for t in binary_texts(batch.column(1))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), packed, *batch.columns[2:]], ["doc_id", "packed", *others])

    schema = StructType([*StructType.fromDDL("doc_id long, packed binary"), *(docs.schema[n] for n in others)])
    return docs.select("doc_id", "text", *others).mapInArrow(run, schema)


def unpack(column) -> list[bytes]:
    import zstandard

    large = zstandard.ZstdDecompressor()
    return [large.decompress(x) for x in (column.to_pylist() if isinstance(column, pa.Array) else column)]
