"""Queries of the training-data operators and of the pipeline and, where SQL can express them, their SQL."""

from __future__ import annotations

import corpus_pipeline

from . import bpe, decontaminate, fingerprints, html_text, language_id, line_dedup, near_dedup, pii, token_counts, url_filter

QUERIES = {
    "op1_url_filter": url_filter.query,
    "op2_language_id": language_id.query,
    "op3_pii": pii.query,
    "op4_fingerprints": fingerprints.query,
    "op5_line_dedup": line_dedup.query,
    "op6_html_text": html_text.query,
    "op7_bpe": bpe.query,
    "op8_minhash_near_dedup": near_dedup.query,
    "op9_decontamination": decontaminate.query,
    "op10_token_counts": token_counts.query,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {"op5_line_dedup": line_dedup.ORACLE, "op8_minhash_near_dedup": near_dedup.ORACLE}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
