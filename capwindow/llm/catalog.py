"""The queries of this subpackage, one for each operator."""

from __future__ import annotations

from capwindow.llm import bpe, language, licenses, mixing, neardup, pii, quality, secrets, tiff, token_counts


def queries():
    return {
        "op1_mixing": mixing.query,
        "op2_language": language.query,
        "op3_pii_anchors": pii.query,
        "op4_tiff": tiff.query,
        "op5_near_duplicates": neardup.query,
        "op6_secrets": secrets.query,
        "op7_licenses": licenses.query,
        "op8_host_quality": quality.query,
        "op9_byte_bpe": bpe.query,
        "op10_token_counts": token_counts.query,
    }


def oracle_sql():
    """Positions of matches, stored media and merges are beyond SQL; tests compare these with brute force."""
    return {"op5_near_duplicates": neardup.ORACLE, "op7_licenses": licenses.oracle(), "op8_host_quality": quality.ORACLE}
