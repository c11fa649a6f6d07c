"""A corpus pipeline over ``documents``: five stages, each written as Parquet and read again by the next.

language ID -> near duplicates -> benchmark decontamination -> PII -> SentencePiece

Every stage takes all rows of its predecessor and reads the columns of ``documents`` only; others, whatever their names, go. An
empty table gives an empty one. Repeated rows are rows of their own, of which the second stage keeps one. A null text has no
language and goes in the first stage; in a later stage it has no shingle, no passage and no personal data, stays, and has no pieces.
Null keys are allowed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.lineage import delete_folder, shared_folder
from tidemark.llm import decontam, jaccard, langid, pii, sentencepiece
from tidemark.llm.tables import read

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
LEAST_SCORE = 0.5
"""Below this share of the posterior the language of a text is not settled."""


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter or without a settled language. The model learns from labelled rows that are not held out."""
    model = langid.fit(docs.where(~langid.held_out()))
    found = langid.predict(docs.select(*COLUMNS), model)
    return found.where((F.col("lang_pred") != "und") & (F.col("lang_score") >= LEAST_SCORE)).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near duplicates the document with the least doc_id."""
    return jaccard.keep_first(docs.select(*COLUMNS))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark."""
    return decontam.without_leaks(docs.select(*COLUMNS), read(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by the name of its kind; n_chars follows the new text."""
    return pii.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the ids of each text's pieces, their number, and whether they decode to the text."""
    return sentencepiece.encode(docs.select(*COLUMNS))


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("pii", redact_personal_data),
    ("sentencepiece", encode_pieces),
]

# Viterbi segmentation and chosen paths have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what each returns is written to the shared folder and read again.

    A stage's folder goes once the next one's is complete; the last folder stays, as the result reads it.
    """
    folder, before = shared_folder(spark, "pipeline"), None
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        here = f"{folder}/{i}_{name}"
        out.write.parquet(here)
        docs = spark.read.parquet(here)
        if before is not None:
            delete_folder(spark, before)
        before = here
    return docs
