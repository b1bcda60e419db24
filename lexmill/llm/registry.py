"""Queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexmill.llm import (
    decontamination,
    language_id,
    license_scan,
    line_dedup,
    minhash_dedup,
    mixing,
    quality_classifier,
    quality_rules,
    secret_scan,
    token_counts,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": quality_rules.query,
        "op2_license_scan": license_scan.query,
        "op3_minhash_dedup": minhash_dedup.query,
        "op4_secret_scan": secret_scan.query,
        "op5_token_counts": token_counts.query,
        "op6_line_dedup": line_dedup.query,
        "op7_source_mix": mixing.query,
        "op8_language_id": language_id.query,
        "op9_quality_classifier": quality_classifier.query,
        "op10_decontamination": decontamination.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": quality_rules.SQL,
        "op3_minhash_dedup": minhash_dedup.SQL,
        "op6_line_dedup": line_dedup.SQL,
        "op10_decontamination": decontamination.SQL,
    }
