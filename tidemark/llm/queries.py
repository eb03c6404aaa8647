"""The operators of this subpackage as queries over whole tables, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroid_clustering, exact_dedup, filter_audit, html_extract, huffman_ids, ngram_join, packing, quality_classifier, quality_rules, sentencepiece_fst, substring_dedup, token_count, warc
from .common import table


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer file lies; the installed package knows."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.responses(table(spark, sf_dir, "pages")))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op9_sentencepiece_fst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_fst.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman_ids.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clustering.cluster(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_warc_derivatives, op2_quality_rules, op3_token_counts, op4_exact_dedup, op5_html_extract, op6_quality_classifier, op7_ngram_join, op8_best_fit_packing, op9_sentencepiece_fst, op10_substring_dedup]
    found += [op11_filter_audit, op12_huffman_ids, op13_centroid_clustering]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op11_filter_audit": filter_audit.SQL,
        "op13_centroid_clustering": centroid_clustering.SQL,
        "op4_exact_dedup": r"""
            with d as (select doc_id, length(coalesce(text, '')) as n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256 from documents)
            select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from (
                select doc_id, text_sha256, first_value(doc_id) over (partition by text_sha256 order by n desc, doc_id) as keep_id,
                    count(*) over (partition by text_sha256) as group_size from d)
        """,
        "op10_substring_dedup": r"""
            with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
            win as (select doc_id, unnest(range(1, len(words) - 11)) as pos, words from w where len(words) >= 13),
            own as (select doc_id, pos, min(doc_id) over (partition by array_to_string(words[pos : pos + 12], ' ')) as owner from win),
            gone as (select distinct doc_id, unnest(range(pos, pos + 13)) as pos from own where owner < doc_id),
            each as (select doc_id, unnest(words) as word, unnest(range(1, len(words) + 1)) as pos from w),
            kept as (select e.doc_id, string_agg(word, ' ' order by e.pos) as kept, count(*) as n from each e anti join gone g on e.doc_id = g.doc_id and e.pos = g.pos group by e.doc_id)
            select w.doc_id, len(words)::bigint as n_words, (len(words) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
            from w left join kept using (doc_id)
        """,
    }
