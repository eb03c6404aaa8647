"""Exact dedup by skew-safe combining.

Each row is reduced to a pick, a number that orders rows of equal text: more code points first, then the
smaller doc_id. Combining runs in three steps that all group by the digest *and* the whole normalised text:
within each task (Spark's partial aggregation), among the rows of a digest that share a salt, and among the
winners of the salts. So a text that a third of all rows share reaches any task as a few rows. The rows then look
their winner up; those of very common texts are salted again for that, and their winner stands under every salt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_RUN, discard, materialize

#: A text is common if more than one of so many rows has it; so there are fewer common texts than that.
COMMON = 1000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, "")


def digest(text: Column) -> Column:
    """SHA-256 of the normalised text."""
    return F.unhex(F.sha2(normalised(text), 256))


def winners(docs: DataFrame, salts: int) -> DataFrame:
    """digest, body, keep_id and group_size of each distinct normalised text."""
    # pick = n_chars * 2^64 - doc_id, in one decimal, so that plain hash aggregation can hold it.
    rows = docs.select(
        normalised(F.col("text")).alias("body"),
        F.expr(f"cast(length(coalesce(text, '')) as decimal(17,0)) * {2**64}BD - doc_id").cast("decimal(38,0)").alias("pick"),
        F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"),
    )
    rows = rows.select(F.unhex(F.sha2("body", 256)).alias("digest"), "body", "pick", "salt")
    salted = rows.groupBy("digest", "salt", "body").agg(F.max("pick").alias("pick"), F.count("*").alias("n"))
    won = salted.groupBy("digest", "body").agg(F.max("pick").alias("pick"), F.sum("n").alias("group_size"))
    keep = F.expr(f"cast(((pick + {2**63 - 1}BD) div {2**64}BD) * {2**64}BD - pick as long)")
    return won.select("digest", "body", keep.alias("keep_id"), "group_size")


def exact_dedup(docs: DataFrame, salts: int = 8) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after deleting all of `[\\x20\\x09-\\x0D]`; null counts as empty. The row with
    the most code points, then the smallest doc_id, stays. Repeated rows of one doc_id are counted one by one
    and marked alike. A row without doc_id counts in its group's size, but never stays: a group of only such rows has
    no keep_id. An empty table gives an empty result; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = docs.select("doc_id", digest(F.col("text")).alias("digest"))
    won = materialize(winners(docs, salts).select("digest", "keep_id", "group_size"), "exact-winners")
    by = ["digest"]
    if not won.groupBy("digest").count().where("count > 1").isEmpty():
        # Different texts under one digest: its rows are held against the texts themselves.
        discard(won)
        by = ["digest", "body"]
        won = materialize(winners(docs, salts), "exact-winners")
        rows = docs.select("doc_id", digest(F.col("text")).alias("digest"), normalised(F.col("text")).alias("body"))
    total = won.agg(F.sum("group_size")).first()[0] or 0
    # fewer than COMMON digests, so they can be broadcast at any size of the input
    sizes = won.groupBy("digest").agg(F.sum("group_size").alias("size")).where(F.col("size") * COMMON > total)
    common = F.broadcast(sizes.select("digest", F.ceil(F.col("size") * COMMON / total).alias("salts")))
    salted = rows.join(common, "digest", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("doc_id", F.spark_partition_id()), "salts"), F.lit(0)))
    every = won.join(common, "digest", "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)) - 1)))
    found = salted.join(every.drop("salts"), [*by, "salt"])
    return found.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
