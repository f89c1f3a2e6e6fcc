"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parlance.llm import oracles
from parlance.llm.session import table


def op10_minhash_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parlance.llm.minhash_hamming import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), similarity=0.85)


def op1_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parlance.llm.text_density import extract_pages

    return extract_pages(table(spark, sf_dir, "pages"))


def op2_raking(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parlance.llm.raking import mixing_report

    return mixing_report(table(spark, sf_dir, "documents"))


def op3_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parlance.llm.cotraining import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_wfst(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parlance.llm.wfst import round_trips

    return round_trips(table(spark, sf_dir, "documents"))


def op5_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parlance.llm.spot_signatures import compare_with_next

    return compare_with_next(table(spark, sf_dir, "documents"))


def spot_signature_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parlance.llm.spot_signatures import similar_documents

    return similar_documents(table(spark, sf_dir, "documents"))


def op6_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parlance.llm.reply_trees import conversation_digests

    return conversation_digests(table(spark, sf_dir, "conversations"))


def op7_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parlance.llm.ppm import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


def op8_bucket_refinement(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parlance.llm.bucket_refinement import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op9_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parlance.llm.line_frequency import line_verdicts

    return line_verdicts(table(spark, sf_dir, "documents")).drop("removed_lines")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_text_density": op1_text_density,
        "op2_raking": op2_raking,
        "op3_cotraining": op3_cotraining,
        "op4_wfst": op4_wfst,
        "op5_spot_signatures": op5_spot_signatures,
        "spot_signature_links": spot_signature_links,
        "op6_reply_trees": op6_reply_trees,
        "op7_ppm": op7_ppm,
        "op8_bucket_refinement": op8_bucket_refinement,
        "op9_line_frequency": op9_line_frequency,
        "op10_minhash_hamming": op10_minhash_hamming,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_raking": oracles.OP2,
        "op6_reply_trees": oracles.OP6,
        "op8_bucket_refinement": oracles.OP8,
        "op9_line_frequency": oracles.OP9,
        "op10_minhash_hamming": oracles.OP10,
    }
