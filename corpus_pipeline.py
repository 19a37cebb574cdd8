"""The corpus pipeline: language, repeated lines, near duplicates, personal data, packing.

Each stage takes the documents that the one before kept, as a stored table, and all but the last
return the columns of documents. ``n_chars`` follows the text where a stage changes it.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwick.llm import jaccard, langid, lines, packing, pii
from sparkwick.llm.common import stage

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: Texts whose n-grams are farther than this from every language are rejected.
LOWEST_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters or far from every language learned from the labelled ones."""
    profiles = langid.learn(docs.where(~langid.held_out()))
    found = langid.identify(docs, profiles)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LOWEST_SCORE)).select(
        docs.columns
    )


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut later copies of three-line windows out of the texts."""
    return _measured(lines.drop_repeated_windows(docs), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each component of similar ones, that with the smallest id."""
    return jaccard.join(docs).where("is_kept").select(docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by the name of its kind."""
    return _measured(pii.redact(docs, pii.fit(docs)), docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents' tokens into sequences."""
    pieces = stage(packing.cut_pieces(docs, TOKENIZER), "pieces")
    return packing.pack(pieces).drop("rid")


def _measured(docs: DataFrame, columns: list[str]) -> DataFrame:
    n = F.length("text").cast("long").alias("n_chars")
    return docs.select(*(n if c == "n_chars" else c for c in columns))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("repeated_lines", repeated_lines),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("packed", packed),
]

#: Profiles, components and packing are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; every stage's result is stored and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
