"""Tables that several models read, written once in the folder that driver and executors share."""

from __future__ import annotations

import hashlib
import inspect
import re
import sys
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


@dataclass
class _Model:
    """A stored model: its rows, where they lie, and the versions of all that they were built from."""

    rows: DataFrame
    path: str
    version: str
    sources: dict[str, str] = field(default_factory=dict)
    models: dict[tuple, str] = field(default_factory=dict)


_STORED: dict[tuple, _Model] = {}
_BUILDERS: dict[str, Callable] = {}
#: What the builds that are running have read so far, the innermost last.
_READING: list[_Model] = []
#: States of sources that the running query has looked at, so that it looks once.
_SEEN: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The setting spark.checkpoint.dir; only a local session without it gets a temporary folder."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    context = spark.sparkContext
    if not re.match(r"local(\[|$)", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = tempfile.mkdtemp(prefix="tidemark-")
    return _LOCAL[context.applicationId]


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path in it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def remove(spark: SparkSession, path: str) -> None:
    fs, where = file_system(spark, path)
    fs.delete(where, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows from Parquet files: cuts lineage and survives lost executors. `drop` deletes them."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.folder = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete what `written` wrote, once nothing reads it any more."""
    for df in tables:
        remove(df.sparkSession, df.folder)


def state(spark: SparkSession, path: str) -> str:
    """Changes whenever a file under `path` is added, removed, resized or written anew."""

    def files(fs, where) -> list[tuple[str, ...]]:
        listed = fs.listStatus(where)
        text = spark._jvm.org.apache.commons.lang3.ArrayUtils.toString(listed)  # one call, however many files
        found = re.findall(r"path=([^;]*);.*?length=(\d+);.*?modification_time=(\d+)", text)
        if "isDirectory=true" in text:
            for one in listed:
                if one.isDirectory():
                    found += files(fs, one.getPath())
        return found

    return hashlib.sha256(repr(sorted(files(*file_system(spark, path)))).encode()).hexdigest()


def size(spark: SparkSession, path: str) -> int:
    """Bytes of the files under `path`."""
    fs, where = file_system(spark, path)
    return fs.getContentSummary(where).getLength()


def source(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table that models are built from; the stored models that read it notice when it changes."""
    if _READING:
        _READING[-1].sources[path] = _state_once(spark, path)
    return spark.read.parquet(path)


def _state_once(spark: SparkSession, path: str) -> str:
    if path not in _SEEN:
        _SEEN[path] = state(spark, path)
    return _SEEN[path]


def _code(build: Callable) -> str:
    """The text of the builder's module, as it is loaded."""
    return hashlib.sha256(inspect.getsource(sys.modules[build.__module__]).encode()).hexdigest()


def _current(spark: SparkSession, key: tuple) -> _Model:
    """The stored model, built again if its code, one of its sources or a model that it reads has changed."""
    build, code, old = _BUILDERS[key[2]], _code(_BUILDERS[key[2]]), _STORED.get(key)
    if old and old.sources.get("code") == code and all(_state_once(spark, p) == s for p, s in old.sources.items() if p != "code") and all(_current(spark, k).version == v for k, v in old.models.items()):
        return old
    new = _Model(None, "", "", {"code": code})
    _READING.append(new)
    try:
        rows = build(spark, key[1])
        new.rows = written(rows, build.__name__)
    finally:
        _READING.pop()
    new.path, new.version = new.rows.folder, uuid.uuid4().hex
    _STORED[key] = new
    if old:
        remove(spark, old.path)
    return new


def stored(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Keep a model written, for each folder of tables, as long as what it was built from stays as it is.

    Each call compares the sources' files (names, sizes, times), the builder's code and the stored models in between.
    What has changed is built again, with all that reads it and nothing else; the files before it are deleted, so a
    result that still reads them must have been written by then.
    """
    name = f"{build.__module__}.{build.__qualname__}"
    _BUILDERS[name] = build

    @wraps(build)
    def get(spark: SparkSession, sf: str) -> DataFrame:
        key, outermost = (spark.sparkContext.applicationId, sf, name), not _READING
        if outermost:
            _SEEN.clear()
        model = _current(spark, key)
        if not outermost:
            _READING[-1].models[key] = model.version
        return model.rows

    return get


def refresh() -> None:
    """Forget the stored models and delete their files."""
    for model in _STORED.values():
        if model.rows.sparkSession.sparkContext._jsc is not None:
            remove(model.rows.sparkSession, model.path)
    _STORED.clear()
