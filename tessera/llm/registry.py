"""Queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, decontaminate, html_text, jaccard_join, line_dedup, pii, quality_rules, relative_lz, source_audit, suffix_dedup, token_counts, warc, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_bpe": bpe.op3_bpe,
    "op4_jaccard_join": jaccard_join.op4_jaccard_join,
    "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op7_warc": warc.op7_warc,
    "op8_pii": pii.op8_pii,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_html_text": html_text.op10_html_text,
    "op11_relative_lz": relative_lz.op11_relative_lz,
    "op12_source_divergence": source_audit.op12_source_divergence,
    "op13_whitening": whitening.op13_whitening,
}

ORACLE_SQL: dict[str, str] = {
    "op2_line_dedup": line_dedup.OP2_SQL,
    "op6_quality_rules": quality_rules.OP6_SQL,
    "op9_decontaminate": decontaminate.OP9_SQL,
    "op12_source_divergence": source_audit.OP12_SQL,
}
