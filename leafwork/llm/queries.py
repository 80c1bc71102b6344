"""The operators' queries over their whole tables, and SQL where it can express them."""

from __future__ import annotations

from leafwork.llm import bpe, fingerprints, language_id, license_scan, line_dedup, mixing, near_dedup, simple8b, topk, toxicity

QUERIES = {
    "op1_topk": topk.query,
    "op2_license_scan": license_scan.query,
    "op3_language_id": language_id.query,
    "op4_fingerprints": fingerprints.query,
    "op5_mixing": mixing.query,
    "op6_near_dedup": near_dedup.query,
    "op7_toxicity": toxicity.query,
    "op8_simple8b": simple8b.query,
    "op9_bpe": bpe.query,
    "op10_line_dedup": line_dedup.query,
}
SQL = {"op1_topk": topk.SQL, "op5_mixing": mixing.SQL, "op10_line_dedup": line_dedup.SQL}
