"""From raw documents to packed training sequences, in stages that each keep their own result.

Every stage takes all documents that the one before kept and returns documents with the same
columns; the last returns the pieces of the packed sequences.  ``run`` writes each stage's result
to the shared folder and reads it again, so a lost executor costs at most one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from goldseam.llm import jaccard_join, language_id, line_dedup, mixing, packing
from goldseam.llm.common import documents, stored
from goldseam.llm.tokens import vocabulary_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; the rest go."""
    return language_id.in_known_language(docs)


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the multi-line chunks that occur elsewhere before; all documents stay."""
    cleaned = line_dedup.line_dedup(docs)
    if "n_chars" not in cleaned.columns:
        return cleaned
    kind = docs.schema["n_chars"].dataType
    return cleaned.withColumn("n_chars", F.length("text").cast(kind))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies."""
    return jaccard_join.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated as often as their sources' weights ask for, in a random order."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their token ids and their places in sequences."""
    return packing.packed(docs, vocabulary_path())


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", remove_repeated_lines),
    ("jaccard_join", keep_one_of_near_copies),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

# Dictionaries of a compressor, and the packing's choices, have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
