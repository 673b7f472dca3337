"""The corpus pipeline: language ID, near duplicates, repeated passages, source mix, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next stage's docs.
All stages but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galena.llm import bpe, lang_id, mixing, ngram_join, suffix_dedup
from galena.llm.queries import word_vocabulary
from galena.session import cut

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: SQL can't express the stages' models, joins and suffix arrays; tests hold them against brute force.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a language is found for; lang becomes the predicted one. Null texts and texts without a letter go."""
    found = lang_id.identify(docs)
    kept = found.where(F.col("lang_pred") != lang_id.UNKNOWN)
    return kept.select(*[F.col("lang_pred").alias("lang") if c == "lang" else c for c in COLUMNS])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles with a similarity of 0.8 or more: that with the smallest id."""
    return ngram_join.keep_one(docs, k=5, numerator=80, denominator=100).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that repeat an earlier passage of 100 bytes or more. Characters cut apart go whole; texts of which nothing is left go."""
    kept = suffix_dedup.without_repeats(docs, 100)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per copy that the mix takes, in training order."""
    return mixing.training_order(docs).select(*COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids and n_tokens of each row."""
    coded = docs.select("doc_id", "lang", "source", bpe.encode(F.col("text"), word_vocabulary()).alias("ids"))
    return coded.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mix", source_mix),
    ("token_ids", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
