"""Queries of the corpus operators and their SQL."""

from __future__ import annotations

from folioflow.llm import bpe, decontaminate, fingerprints, html, language, licenses, ngramjoin, quality, sharding, substrings


def queries() -> dict:
    """Name -> (spark, sf_dir) -> DataFrame."""
    return {
        "op1_quality_classifier": quality.op1_quality_classifier,
        "op2_html_extraction": html.op2_html_extraction,
        "op3_decontamination": decontaminate.op3_decontamination,
        "op4_document_fingerprints": fingerprints.op4_document_fingerprints,
        "op5_license_scan": licenses.op5_license_scan,
        "op6_substring_dedup": substrings.op6_substring_dedup,
        "op7_language_id": language.op7_language_id,
        "op8_ngram_jaccard_join": ngramjoin.op8_ngram_jaccard_join,
        "op9_bpe": bpe.op9_bpe,
        "op10_sharding": sharding.op10_sharding,
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express."""
    return {
        "op4_document_fingerprints": fingerprints.oracle(),
        "op5_license_scan": licenses.oracle(),
        "op6_substring_dedup": substrings.oracle(),
        "op7_language_id": language.oracle(),
        "op8_ngram_jaccard_join": ngramjoin.oracle(),
        "op10_sharding": sharding.oracle(),
    }
