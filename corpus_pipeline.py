"""From raw documents to packed training sequences, in five stages.

Each stage reads the columns of `documents` and returns them, without the rows that it rejects; the last one
returns packed pieces. Rows without doc_id can't be told from each other or ordered: they pass the dedup stages
untouched and take nothing from others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, ngram_join, packing, quality_rules, substring_dedup
from tidemark.llm.common import materialize, table
from tidemark.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    verdicts = quality_rules.kept_documents(docs, table(spark, sf_dir, "labels"))
    return verdicts.select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each kept text: of rows with its doc_id, the longest (then the greatest by its columns)."""
    kept = exact_dedup.exact_dedup(docs.where("doc_id is not null")).where("kept").select(F.col("doc_id").alias("id"), F.unhex("text_sha256").alias("digest")).distinct()
    row = F.struct(F.length(F.coalesce("text", F.lit(""))), F.struct(*docs.columns).alias("row"))
    keys = F.col("doc_id").cast("long").alias("id"), exact_dedup.digest(F.col("text")).alias("digest")
    # repeated rows are one within each task, before the shuffle that the join needs as well
    named = docs.where("doc_id is not null")
    rows = named.select(*keys, row.alias("x")).groupBy("id", "digest").agg(F.max("x").alias("x"))
    return rows.join(kept, ["id", "digest"], "left_semi").select("x.row.*").unionByName(docs.where("doc_id is null"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = ngram_join.ngram_join(docs).where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").select(*docs.columns).unionByName(docs.where("doc_id is null"))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    carried = docs.withColumn("row", F.struct(*rest, F.col("text").isNull().alias("no text")))
    done = substring_dedup.substring_dedup(carried, with_text=True, others=("row",))
    new = {"doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType), "text": F.when(~F.col("row.no text"), F.col("text"))}
    new["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars"))
    return done.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("ngram_join", near), ("substring_dedup", substrings), ("best_fit_packing", packed)]

#: The learned rules and the packing can't be said in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
