"""The operators with production parameters over their whole tables, as registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from goldseam.llm import (
    alignment,
    decontamination,
    exact_dedup,
    jaccard_join,
    language_id,
    line_dedup,
    lm_score,
    mixing,
    neighbours,
    packing,
    periodic_runs,
    secret_scan,
    token_files,
)
from goldseam.llm.common import documents, new_folder, stored
from goldseam.llm.tokens import piece_vocabulary_path, vocabulary_path

Query = Callable[[SparkSession, str], DataFrame]


def secret_scan_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(secret_scan.secret_spans(documents(spark, sf_dir)))


def exact_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(documents(spark, sf_dir))


def jaccard_join_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_links(documents(spark, sf_dir))


def packing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir), vocabulary_path(), keep_ids=False)


def language_id_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(documents(spark, sf_dir))


def neighbours_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def line_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(documents(spark, sf_dir), counts=True).select(
        "doc_id", "text", "n_lines", "n_removed"
    )


def token_files_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "tokens")
    docs = documents(spark, sf_dir)
    shards = token_files.write_files(docs, folder, vocabulary_path())
    return token_files.read_files(shards, folder, docs.schema["doc_id"].dataType.simpleString())


def lm_scoring_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_scores(documents(spark, sf_dir))


def mixing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(
        documents(spark, sf_dir), copy_column="copy", key_column="order_key"
    ).select("doc_id", "source", "copy", "order_key", "text")


def periodic_runs_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = periodic_runs.with_repetitions(documents(spark, sf_dir))
    return periodic_runs.digests(periodic_runs.periodic_runs(texts))


def alignment_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.alignments(
        documents(spark, sf_dir), vocabulary_path(), piece_vocabulary_path()
    )
    return alignment.with_counts(stored(alignment.with_digests(found), "alignments"))


def decontamination_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.digests(
        decontamination.benchmark_passages(documents(spark, sf_dir), benchmark)
    )


def registered() -> dict[str, Query]:
    return {
        "op1_secret_scan": secret_scan_query,
        "op2_exact_dedup": exact_dedup_query,
        "op3_jaccard_join": jaccard_join_query,
        "op4_best_fit_packing": packing_query,
        "op5_language_id": language_id_query,
        "op6_nearest_neighbours": neighbours_query,
        "op7_line_dedup": line_dedup_query,
        "op8_token_files": token_files_query,
        "op9_lm_scoring": lm_scoring_query,
        "op10_source_mixing": mixing_query,
        "op11_periodic_runs": periodic_runs_query,
        "op12_alignment": alignment_query,
        "op13_decontamination": decontamination_query,
        "pipeline": corpus_pipeline.run,
    }
