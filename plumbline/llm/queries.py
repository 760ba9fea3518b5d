"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline

from . import conversation_repair, embedding_dedup, html_extract, jaccard_join, lm_scoring, mixing, packing, periodic_runs, pii, simhash, substring_dedup, token_counts, toxicity

QUERIES = {
    "op1_substring_dedup": substring_dedup.query,
    "op2_mixing": mixing.query,
    "op3_packing": packing.query,
    "op4_embedding_dedup": embedding_dedup.query,
    "op5_html_extract": html_extract.query,
    "op6_jaccard_join": jaccard_join.query,
    "op7_simhash": simhash.query,
    "op8_lm_scoring": lm_scoring.query,
    "op9_toxicity": toxicity.query,
    "op10_pii": pii.query,
    "op11_periodic_runs": periodic_runs.query,
    "op12_conversation_repair": conversation_repair.query,
    "op13_token_counts": token_counts.query,
    "pipeline": corpus_pipeline.run,
}

#: None of these has a practical SQL form over whole tables; the tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {}
