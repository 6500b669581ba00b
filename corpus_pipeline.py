"""Corpus pipeline: language ID, line dedup, near dedup, decontamination, SentencePiece.

Each stage takes the documents that its predecessor kept, with the columns of `documents`,
and gives the same columns; the last gives token ids. Documents are filtered and, by line
dedup, shortened; n_chars follows the text. `run` stages every result in the shared folder.

Defined results: rows with null or empty texts are rejected by language ID, as they have no
letter, and so are texts in scripts that no learned language writes. A document all of whose lines repeat earlier ones has nothing left and is dropped.
Rows that repeat an id and its text share every decision. Columns other than those of
`documents` are dropped by the first stage. Empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm import decontaminate, langid, line_dedup, near_dedup, pieces
from cuelake.llm.common import staged, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _join_rows(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of docs whose id found holds (once each); repeated and null ids included."""
    return docs.alias("d").join(found.select(F.col("doc_id").alias("__id")).distinct(), F.col("d.doc_id").eqNullSafe(F.col("__id")), "left_semi")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language, mixtures of several included; learned from all labelled documents of the input."""
    docs = docs.select(*COLUMNS)
    model = langid.train(docs)
    found = langid.identify(docs, model, keep=COLUMNS[1:])
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") > 0)).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated and nearly repeated lines; those with nothing left go."""
    return line_dedup.line_dedup(docs, keep=("lang", "source")).withColumn("n_chars", F.length("text").cast("long")).filter(F.trim(F.translate("text", "\n\t\r", "   ")) != "").select(*COLUMNS)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more."""
    return _join_rows(docs, near_dedup.near_dedup(docs, words=5, percent=80).filter("kept"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no part of a benchmark item."""
    found = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"), keep=COLUMNS[1:])
    return found.filter(F.size("hits") == 0).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and lossless (ids decode to the text)."""
    return pieces.encode_decode(docs, pieces.piece_model_path()).drop("decoded")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near),
    ("decontaminate", drop_leaks),
    ("sentencepiece", tokenize),
]

#: Viterbi over learned scores, alignment and tokenization are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
