"""A corpus pipeline: quality rules, near-duplicates, secrets, source mix, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; between stages the documents are
written as Parquet and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bpe import token_digests
from tidemark.llm.common import documents, written
from tidemark.llm.mixing import mixed
from tidemark.llm.neardup import simhash_classes
from tidemark.llm.quality import robust_outliers
from tidemark.llm.secrets import redacted


def _key() -> Column:
    """Tells rows apart that share an id: 128 bits of the row."""
    row = ("doc_id", "text", "lang", "source")
    return F.concat(*(F.lpad(F.hex(F.xxhash64(F.lit(seed), *row)), 16, "0") for seed in (1, 2)))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie outside their language and source's estimate go. Equal rows go or stay
    together; an empty table gives none."""
    del spark, sf_dir
    judged = robust_outliers(docs.select(_key().alias("_key"), "text", "lang", "source"))
    kept = judged.where("kept").select(F.col("_row._key").alias("_key")).distinct()
    return docs.withColumn("_key", _key()).join(kept, "_key", "left_semi").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash class stays, the one with the smallest id, null last, and of those the one with the
    smallest key. Rows that share an id, or have none, are compared like all others."""
    del spark, sf_dir
    keyed = docs.withColumn("_key", _key())
    classes = simhash_classes(keyed, id_col="_key").select("_key", "component_id").distinct()
    ids = keyed.select("_key", "doc_id").distinct()
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "_key")
    winners = classes.join(ids, "_key").groupBy("component_id").agg(F.min_by("_key", order).alias("_key")).select("_key")
    return keyed.join(winners, "_key", "left_semi").dropDuplicates(["_key"]).select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret in a text gives way to a mark; all documents stay."""
    del spark, sf_dir
    clean = redacted(docs)
    size = F.coalesce(F.char_length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))
    return clean.withColumn("n_chars", size).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to the sources' targets takes them, those that share an id alike. Empty and null texts
    have no words and are never taken."""
    del spark, sf_dir
    return mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of each taken row, repeated rows each; a null text is empty."""
    del spark, sf_dir
    return token_digests(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
    ("tokens", tokens),
]

#: The stages iterate to estimates and components and run tokenizer merges, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
