"""A corpus pipeline: language, toxicity, near copies, repeated passages, packing.

Each stage takes (spark, docs, sf_dir), where ``docs`` is what the stage before kept, and
returns the columns of ``documents``; the last one returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusflow.llm import language_id, simhash, toxicity
from locusflow.llm.common import stored, table
from locusflow.llm.packing import pack
from locusflow.llm.queries import fitted_language_model, fitted_toxicity_model
from locusflow.llm.suffix_dedup import remove_repeats

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: A text whose best language has a lower score than this is in none of them.
LEAST_LANGUAGE_SCORE = 0.3

#: Bytes from which a string is a repeated passage: hardly any passage of over fifty words is shorter.
PASSAGE = 240


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter, and those that resemble none of the learnt languages."""
    found = language_id.predict(docs, fitted_language_model(docs), keep=COLUMNS)
    return found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select(*COLUMNS)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents predicted to be toxic."""
    model = fitted_toxicity_model(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, keep=COLUMNS).where("predicted = 0").select(*COLUMNS)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each class of near copies."""
    return simhash.one_of_each(docs.select(*COLUMNS))


def no_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated strings of ``PASSAGE`` bytes; a character that a cut goes through is dropped.

    A document that is cut to nothing stays, with an empty text.
    """
    cut = remove_repeats(docs, keep=("doc_id", "lang", "source"), length=PASSAGE)
    return cut.withColumn("text", F.col("whole")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 2048 ids."""
    return pack(docs)


STAGES = [
    ("language_id", known_language),
    ("toxicity", not_toxic),
    ("simhash_near_dedup", no_near_copies),
    ("suffix_dedup", no_repeats),
    ("best_fit_packing", packed),
]

#: SQL has neither the classifiers nor the tokenizer, so the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for place, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES) - 1:
            docs = stored(docs)
    return docs
