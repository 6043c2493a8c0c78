"""Corpus pipeline: language ID, exact dedup, near-duplicate join, mixing to target weights, SentencePiece tokens.

Each stage is a function of (spark, docs, sf_dir) that works on all rows its predecessor kept and returns the columns of
documents (the last: doc_id, lang, source, ids, n_tokens, round_trip). Between stages the rows are written as Parquet
to the shared folder and read again, so a lost executor repeats a stage's task and nothing before it.

Defined cases are those of the operators; an empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessitura.llm import exact_dedup, jaccard_join, language_id, mixing, piece_tokens
from tessitura.llm.common import settle, table


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose language can't be told: null, empty or letterless texts, and those whose prediction scores
    below ``language_id.LEAST_SCORE`` (words of several languages or of none). A document without a language gets the
    predicted one, which the tokenised rows carry; all else stays as it is."""
    return language_id.keep_languages(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space the row with the smallest doc_id stays; all columns."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the first row stays: the smallest doc_id, of equal ones the smallest class."""
    return jaccard_join.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by their copies in the mixture: none, one or two."""
    return mixing.mixed_rows(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, and the ids of each text with their number and whether they decode to it."""
    return piece_tokens.encode_texts(docs, ["doc_id", "lang", "source"])


STAGES = [
    ("language_id", keep_identified),
    ("exact_dedup", drop_exact_copies),
    ("jaccard_join", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", tokenize),
]

#: SQL can't express the last stage; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
