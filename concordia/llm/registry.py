"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

import corpus_pipeline
from concordia.llm import bpe, exact_dedup, fingerprint, html_extract, langid, near_dedup, packing, quality, secret_scan, sharding

QUERIES = {
    "op1_language_id": langid.query,
    "op2_sharding": sharding.query,
    "op3_packing": packing.query,
    "op4_fingerprint": fingerprint.query,
    "op5_exact_dedup": exact_dedup.query,
    "op6_near_dedup": near_dedup.query,
    "op7_quality": quality.query,
    "op8_bpe": bpe.query,
    "op9_html_text": html_extract.query,
    "op10_secrets": secret_scan.query,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL = {
    "op2_sharding": sharding.ORACLE_SQL,
    "op5_exact_dedup": exact_dedup.ORACLE_SQL,
}
if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
