"""The queries of these operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, fingerprints, langid, line_dedup, minhash_dedup, packing, parity_join, ranked_search, secret_scan, substring_dedup, url_filter



def tokenizer(name: str) -> str:
    """Where the installed package has a vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan.scan_secrets(_documents(spark, sf_dir))
    # base spans and added ones, by start, then kind
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", secret_scan.span_text("spans").alias("spans"), "n_live", "n_shared", "n_example")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(_documents(spark, sf_dir), tokenizer("word_bpe_49k.json"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return url_filter.filter_urls(pages).drop("url")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(_documents(spark, sf_dir))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_exact(_documents(spark, sf_dir))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_passages(_documents(spark, sf_dir), with_text=False)


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(_documents(spark, sf_dir), shingle=3, limit=(85, 100))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = langid.train(docs, langid.fold() != 2)
    out = langid.predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (langid.fold() == 2).alias("held_out"), "lang_pred", "score")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.ranked_search(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.jaccard_join(_documents(spark, sf_dir), shingle=3, limit=(90, 100))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_secret_scan, op2_bpe, op3_url_filter, op4_fingerprints, op5_line_dedup, op6_exact_dedup, op7_substring_dedup, op8_minhash, op9_packing, op10_language_id, op11_ranked_search, op12_jaccard_join)
}

ORACLE_SQL = {
    "op3_url_filter": url_filter.rules_sql(),
    "op5_line_dedup": line_dedup.lines_sql(),
    "op6_exact_dedup": exact_dedup.exact_sql(),
    "op7_substring_dedup": substring_dedup.passages_sql(),
    "op11_ranked_search": ranked_search.ranked_sql(),
}
