"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from heronry.llm import katz, line_dedup, mixing, neighbour_votes, packing, piece_counts, quality, simhash_dedup, span_hashes, token_blocks


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_source_mix": lambda s, d: mixing.mix(documents(s, d)),
        "op2_katz_scores": lambda s, d: katz.katz_scores(documents(s, d)),
        "op3_rule_ledger": lambda s, d: quality.ledger(documents(s, d)),
        "rule_ablation": lambda s, d: quality.ablation(quality.store(documents(s, d))),
        "op4_span_hashes": lambda s, d: span_hashes.spans(documents(s, d), table(s, d, "benchmark")),
        "op5_token_blocks": lambda s, d: token_blocks.token_blocks(documents(s, d)),
        "op6_piece_counts": lambda s, d: piece_counts.count_pieces(documents(s, d)),
        "op7_line_dedup": lambda s, d: line_dedup.line_duplicates(documents(s, d)),
        "op8_packing": lambda s, d: packing.packed(documents(s, d)),
        "op9_neighbour_votes": lambda s, d: neighbour_votes.classify(documents(s, d), table(s, d, "labels")),
        "op10_simhash_dedup": lambda s, d: simhash_dedup.near_duplicates(documents(s, d)),
        "pipeline": _pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_source_mix": mixing.SQL, "op3_rule_ledger": quality.SQL, "rule_ablation": quality.ABLATION_SQL, "op4_span_hashes": span_hashes.SQL}
