"""The registered queries of this package and, where SQL can express one, its DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from .bpe import bpe_query
from .common import documents
from .fingerprints import fingerprint_query
from .html import html_query
from .licenses import licenses_query, licenses_sql
from .mixing import mixing_query
from .mtree import search_query, search_sql
from .neardup import near_dedup_query
from .phrases import phrases_query, phrases_sql
from .quality import quality_query
from .repair import repair_query
from .secrets import secrets_query, secrets_sql
from .suffix import suffix_query
from .tokens import tokens_query

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": lambda spark, sf_dir: quality_query(documents(spark, sf_dir)),
    "op2_byte_bpe": lambda spark, sf_dir: bpe_query(documents(spark, sf_dir)),
    "op3_secret_scan": lambda spark, sf_dir: secrets_query(documents(spark, sf_dir)),
    "op4_mixing": lambda spark, sf_dir: mixing_query(documents(spark, sf_dir)),
    "op5_token_counts": lambda spark, sf_dir: tokens_query(documents(spark, sf_dir)),
    "op6_suffix_dedup": lambda spark, sf_dir: suffix_query(documents(spark, sf_dir)),
    "op7_license_scan": lambda spark, sf_dir: licenses_query(documents(spark, sf_dir)),
    "op8_html_extraction": lambda spark, sf_dir: html_query(spark.read.parquet(f"{sf_dir}/pages.parquet")),
    "op9_simhash_near_dedup": lambda spark, sf_dir: near_dedup_query(documents(spark, sf_dir)),
    "op10_fingerprints": lambda spark, sf_dir: fingerprint_query(documents(spark, sf_dir)),
    "op11_exact_search": lambda spark, sf_dir: search_query(spark.read.parquet(f"{sf_dir}/embeddings.parquet")),
    "op12_conversation_repair": lambda spark, sf_dir: repair_query(spark.read.parquet(f"{sf_dir}/conversations.parquet")),
    "op13_collocations": lambda spark, sf_dir: phrases_query(documents(spark, sf_dir)),
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL: dict[str, str] = {"op3_secret_scan": secrets_sql(), "op7_license_scan": licenses_sql(), "op11_exact_search": search_sql(), "op13_collocations": phrases_sql()}
