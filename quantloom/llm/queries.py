"""The operators' queries over their whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quantloom.llm.mixing import MIXTURE_SQL


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quantloom.llm.ann import nearest

    return nearest(_table(spark, sf_dir, "embeddings"))


def op2_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quantloom.llm.substring_dedup import removal_digests

    return removal_digests(_table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quantloom.llm.bpe import token_digests

    return token_digests(_table(spark, sf_dir, "documents"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quantloom.llm.fingerprints import edited_fingerprints

    return edited_fingerprints(_table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quantloom.llm.license_scan import scan

    return scan(_table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quantloom.llm.toxicity import score_documents

    return score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quantloom.llm.simhash import near_components

    return near_components(_table(spark, sf_dir, "documents"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quantloom.llm.html_extract import extract

    return extract(_table(spark, sf_dir, "pages"))


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quantloom.llm.url_filter import judge

    return judge(_table(spark, sf_dir, "pages"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quantloom.llm.mixing import mixture

    return mixture(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_posting_lists, op2_recompression, op3_byte_bpe, op4_fingerprints, op5_license_scan, op6_toxicity, op7_simhash, op8_html, op9_urls, op10_mixing)}
ORACLE: dict[str, str] = {"op10_mixing": MIXTURE_SQL}
