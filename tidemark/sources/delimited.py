"""Quarterly tab-delimited text to raw tables, with rejects counted."""

from __future__ import annotations

import warnings
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_BAD = "_rejected_line"
#: So many first lines are read at a time.
HEADERS_AT_ONCE = 8


def quarters(first: str, last: str) -> list[str]:
    """Quarter names from `first` to `last`, both included: 2019q1, 2019q2, ..."""
    number = lambda q: int(q[:4]) * 4 + int(q[5]) - 1
    return [f"{k // 4}q{k % 4 + 1}" for k in range(number(first), number(last) + 1)]


def _files(spark: SparkSession, root: str, names: list[str], member: str) -> list[str]:
    """A member's files in some quarters, whatever their case, found by one listing; a warning where a quarter lacks it."""
    try:
        found = spark.read.text(f"{root}/{{{','.join(names)}}}").inputFiles()
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        found = []
    mine = {}
    for file in sorted(found):
        folder, _, name = file.rpartition("/")
        if name.lower() == f"{member}.txt".lower():
            mine.setdefault(folder.rpartition("/")[2], file)
    for quarter in names:
        if quarter not in mine:
            warnings.warn(f"{quarter} has no {member}.txt", stacklevel=3)
    return [mine[q] for q in names if q in mine]


def _headers(spark: SparkSession, files: list[str]) -> dict[tuple[str, ...], list[str]]:
    """Files by the columns that their first lines name. Each first line is a small job; several run at a time."""
    with ThreadPoolExecutor(HEADERS_AT_ONCE) as pool:
        heads = pool.map(lambda file: spark.read.text(file).first(), files)
        found: dict[tuple[str, ...], list[str]] = {}
        for file, head in zip(files, heads, strict=True):
            if head:
                found.setdefault(tuple(head["value"].rstrip("\r").split("\t")), []).append(file)
    return found


def read_files(spark: SparkSession, names: tuple[str, ...], files: list[str], member: str) -> tuple[DataFrame, DataFrame]:
    """Rows and rejects of files with the same header, in one scan.

    No quoting; empty fields are null; blank lines are skipped; a line with more or fewer fields than the header is a
    reject. The quarter of a row is read off its file's path.
    """
    schema = ", ".join(f"`{n}` string" for n in [*names, _BAD])
    options = {"header": True, "sep": "\t", "quote": "", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD, "enforceSchema": True, "maxCharsPerColumn": -1, "columnPruning": False}
    lines = spark.read.options(**options).schema(schema).csv(files)
    # Spark wants some other column to be read beside the rejected line
    other = F.length(F.coalesce(F.col(f"`{names[0]}`"), F.lit(""))) >= 0
    stem = F.regexp_extract(F.col("_metadata.file_path"), r"(\d{4}q\d)/[^/]*$", 1).alias("source_quarter")
    rows = lines.where(F.col(_BAD).isNull() & other).select(*(F.nullif(F.col(f"`{n}`"), F.lit("")).alias(n) for n in names), stem)
    bad = lines.where(F.col(_BAD).isNotNull() & other).groupBy(stem).agg(F.count("*").alias("rows_rejected"))
    return rows, bad.select("source_quarter", F.lit(f"{member}.txt").alias("source_file"), F.lit(len(names)).alias("expected_columns"), "rows_rejected")


def load(spark: SparkSession, root: str, names: list[str], member: str) -> tuple[DataFrame, DataFrame]:
    """A member of several quarters as one table, and its rejects. Columns that a quarter lacks are null.

    Quarters with the same header are one scan, so the plan grows with the number of headers, not of quarters.
    """
    parts = [read_files(spark, head, files, member) for head, files in _headers(spark, _files(spark, root, names, member)).items()]
    if not parts:
        raise FileNotFoundError(f"{member}: no quarter of {names} has it")
    merge = lambda a, b: a.unionByName(b, allowMissingColumns=True)
    return reduce(merge, (p[0] for p in parts)), reduce(merge, (p[1] for p in parts))


def land(raw: DataFrame, path: str) -> None:
    """Full refresh of a raw table, a folder per quarter."""
    raw.write.mode("overwrite").partitionBy("source_quarter").parquet(path)


def load_counts(tables: dict[str, DataFrame], rejects: DataFrame) -> DataFrame:
    """table and n: rows of each landed table, and under `rejected` all lines that loading refused."""
    counts = [df.agg(F.lit(name).alias("table"), F.count("*").alias("n")) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, [*counts, rejects.agg(F.lit("rejected").alias("table"), F.coalesce(F.sum("rows_rejected"), F.lit(0)).alias("n"))])
