"""A table that is merged by key, laid out by month, and never seen half-written.

Under the table's folder lie

* `data/<version>/month=<month>`: the rows of a month, as one merge wrote them,
* `manifests/<number>`: the months that are current, their folders, the columns, and the last batch of each stream. The
  highest whole one is the table.

A merge writes its batch once, by month. It looks up in the other months' key column where those keys lie, writes what stays
of those months and its own beside the batch, and publishes all of it by one new manifest. Without that manifest nothing has
happened: readers stay with the one before, and the next merge deletes what was left. Of other months only the keys are read,
and nothing is written.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.operators.bitemporal import perhaps_in
from tidemark.sources.store import file_system, remove

#: Files of a month that one merge writes, at most.
FILES = 8
#: The month of rows without a date; greater than all others, so `since` keeps it.
UNDATED = "undated"
#: Manifests before the current one that stay readable, for queries that began on them.
KEPT = 1


@dataclass
class Manifest:
    number: int = 0
    key: str = ""
    date: str = ""
    schema: str = ""
    months: dict[str, str] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)


def _read_text(fs, where, jvm) -> str:
    stream = fs.open(where)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def manifests(spark: SparkSession, path: str) -> list[Manifest]:
    """All whole manifests, the current one last. One that a lost writer left unfinished is none."""
    fs, where = file_system(spark, f"{path}/manifests")
    known, found = {f.name for f in fields(Manifest)}, []
    for one in fs.listStatus(where) if fs.exists(where) else ():
        if one.getPath().getName().isdigit():
            try:
                text = json.loads(_read_text(fs, one.getPath(), spark._jvm))
                found.append(Manifest(**{k: v for k, v in text.items() if k in known}))  # older ones name an index too
            except ValueError:
                continue
    return sorted(found, key=lambda m: m.number)


def current(spark: SparkSession, path: str) -> Manifest | None:
    found = manifests(spark, path)
    return found[-1] if found else None


def _publish(spark: SparkSession, path: str, manifest: Manifest, after: int) -> None:
    """Write the next manifest; fails if another writer has published that number meanwhile."""
    fs, where = file_system(spark, f"{path}/manifests")
    taken = [int(x.getPath().getName()) for x in fs.listStatus(where) if x.getPath().getName().isdigit()] if fs.exists(where) else []
    newer = [n for n in taken if n > after]
    if newer and any(m.number in newer for m in manifests(spark, path)):
        raise RuntimeError(f"{path} was changed by another writer")
    manifest.number = max([after, *taken]) + 1
    stream = fs.create(spark._jvm.org.apache.hadoop.fs.Path(where, str(manifest.number)), False)
    try:
        stream.write(bytearray(json.dumps(asdict(manifest)).encode()))
    finally:
        stream.close()


def _sweep(spark: SparkSession, path: str) -> None:
    """Delete folders that neither the current manifest nor the KEPT before it name, and older manifests."""
    every = manifests(spark, path)
    used = {f"{path}/{f}" for m in every[-1 - KEPT :] for f in m.months.values()}
    whole = {f.rpartition("/")[0] for f in used}
    for kind in ("data", "keys"):  # keys: the index of older tables
        fs, top = file_system(spark, f"{path}/{kind}")
        for version in fs.listStatus(top) if fs.exists(top) else ():
            own = f"{path}/{kind}/{version.getPath().getName()}"
            if own not in whole:
                remove(spark, own)
                continue
            for part in fs.listStatus(version.getPath()):
                name = part.getPath().getName()
                if part.isDirectory() and f"{own}/{name}" not in used:
                    remove(spark, f"{own}/{name}")
    for m in every[: -1 - KEPT]:
        remove(spark, f"{path}/manifests/{m.number}")


def _rows(spark: SparkSession, path: str, folders: list[str], schema: StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(*(f"{path}/{f}" for f in folders)) if folders else spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """The table as its current manifest says; with `since` (yyyy-MM) only that month, later ones and rows without a date."""
    m = current(spark, path)
    if m is None:
        raise FileNotFoundError(f"{path} has no manifest")
    return _rows(spark, path, [f for month, f in sorted(m.months.items()) if since is None or month >= since], StructType.fromJson(json.loads(m.schema)))


def _write(rows: DataFrame, path: str, version: str) -> dict[str, str]:
    """Add rows to the months of a version; gives the months that it has by now, and their folders."""
    rows.write.mode("append").option("compression", "zstd").partitionBy("month").parquet(f"{path}/{version}")
    fs, where = file_system(rows.sparkSession, f"{path}/{version}")
    names = [x.getPath().getName() for x in fs.listStatus(where) if x.isDirectory()]
    return {n.partition("=")[2]: f"{version}/{n}" for n in names if n.startswith("month=")}


def _month(date: str):
    return F.coalesce(F.date_format(date, "yyyy-MM"), F.lit(UNDATED))


def _dealt(rows: DataFrame, date: str, near: str, parts: int | None = None) -> DataFrame:
    """Rows by month, each month in up to FILES parts; rows of one `near` lie beside each other."""
    by = [_month(date), F.pmod(F.xxhash64(F.col(near).cast("string")), F.lit(FILES))]
    return rows.repartition(*([parts] if parts else []), *by).withColumn("month", _month(date)).sortWithinPartitions("month", near)


def _hashed(key: str):
    return F.xxhash64(F.col(key).cast("string")).alias("hash")


def merge(batch: DataFrame, path: str, key: str, date: str, stream: str | None = None, number: int | None = None, near: str | None = None, columns: list[str | Column] | None = None, parts: int | None = None) -> bool:
    """Replace all rows that have a key of the batch by the batch's rows, in whatever months they lie.

    The first merge makes the table. Keys may repeat, null is a key, rows without a date have a month of their own, and
    columns that the table lacks are added (null in older rows). A batch `number` of a `stream` that has been merged
    already, or an empty batch, changes nothing; gives whether something was published.

    Rows are dealt to their months by a hash of `near`, a column of batch and table (the key, if none is given), into
    `parts` partitions if given.
    `columns` are the table's and are made after that from the batch's, so wide ones aren't shuffled.
    """
    spark, old = batch.sparkSession, current(batch.sparkSession, path)
    m = old or Manifest(key=key, date=date)
    if (m.key, m.date) != (key, date):
        raise ValueError(f"{path} is kept by {m.key} and {m.date}")
    if stream is not None and number <= m.batches.get(stream, -1):
        return False
    rows = _dealt(batch, date, near or key, parts)
    rows = rows.select(*columns, "month") if columns else rows
    schema = rows.drop("month").schema
    if m.schema:
        types = lambda x: {f.name: f.dataType for f in x}
        none = _rows(spark, path, [], StructType.fromJson(json.loads(m.schema)))
        schema, new = none.unionByName(rows.drop("month"), allowMissingColumns=True).schema, types(schema)
        if types(schema) != new:
            rows = none.withColumn("month", F.lit("")).unionByName(rows, allowMissingColumns=True)
    version = f"data/{uuid.uuid4().hex}"
    wrote = _write(rows, path, version)
    if not wrote:
        remove(spark, f"{path}/{version}")
        return False
    mine = _rows(spark, path, list(wrote.values()), schema).select(F.col(key).cast("string").alias("key"))
    # months of its own are written again in any case; a hash says where else to look, keys decide below
    held = _rows(spark, path, [f for x, f in m.months.items() if x not in wrote], schema).select(_hashed(key), _month(date).alias("month"))
    moved = [r.month for r in held.join(mine.select(_hashed("key")), "hash", "left_semi").select("month").distinct().collect()] if {*m.months} - {*wrote} else []
    touched = [m.months[x] for x in sorted({*wrote, *moved}) if x in m.months]
    if touched:
        was = _rows(spark, path, touched, schema)
        n = was.count()  # from the files' footers
        met = perhaps_in(mine, F.col("key"), was.select(F.col(key).cast("string")), n) if n < mine.count() else mine
        kept = was.alias("a").join(met.alias("b"), F.col(f"a.{key}").cast("string").eqNullSafe(F.col("b.key")), "left_anti")
        wrote = _write(_dealt(kept, date, near or key), path, version)
    gone = {x for x in moved if x not in wrote}  # all of its rows have moved elsewhere
    _publish(spark, path, Manifest(0, key, date, schema.json(), {x: f for x, f in m.months.items() if x not in gone} | wrote, m.batches | ({stream: number} if stream is not None else {})), m.number)
    _sweep(spark, path)
    return True
