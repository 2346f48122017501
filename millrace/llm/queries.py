"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

import corpus_pipeline

from . import bpe, exact_dedup, license_scan, mixing, ngram_join, pii, quality, suffix_dedup, token_counts, toxicity

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_toxicity": toxicity.query,
    "op2_bpe": bpe.query,
    "op3_quality": quality.query,
    "op4_mix": mixing.query,
    "op5_pii": pii.query,
    "op6_suffix_dedup": suffix_dedup.query,
    "op7_token_counts": token_counts.query,
    "op8_license_scan": license_scan.query,
    "op9_ngram_join": ngram_join.query,
    "op10_exact_dedup": exact_dedup.query,
}
ORACLE_SQL = {
    "op8_license_scan": license_scan.ORACLE,
    "op9_ngram_join": ngram_join.ORACLE,
    "op10_exact_dedup": exact_dedup.ORACLE,
}
