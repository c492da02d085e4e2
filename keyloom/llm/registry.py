"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, langid, linededup, mixing, pii, preferences, quality, rollup, shingle_join


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii_spans": pii.op1_pii_spans,
        "op2_language_mixture": langid.op2_language_mixture,
        "op3_multiprobe_search": ann.op3_multiprobe_search,
        "op4_bpe_round_trip": bpe.op4_bpe_round_trip,
        "op5_host_rules": quality.op5_host_rules,
        "op6_preference_pairs": preferences.op6_preference_pairs,
        "op7_mix_sources": mixing.op7_mix_sources,
        "op8_line_dedup": linededup.op8_line_dedup,
        "op9_rollup_deltas": rollup.op9_rollup_deltas,
        "op10_shingle_join": shingle_join.op10_shingle_join,
        "host_rules_by_length": quality.host_rules_by_length,
        "rollup_of_words": rollup.rollup_of_words,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_host_rules": quality.SQL,
        "op6_preference_pairs": preferences.SQL,
        "op7_mix_sources": mixing.SQL,
        "op8_line_dedup": linededup.SQL,
        "rollup_of_words": rollup.SQL,
        "host_rules_by_length": quality.SQL_BY_LENGTH,
    }
