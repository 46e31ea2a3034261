"""The queries of this package and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from tessera.llm import cover_tree, decontaminate, ngram_join, packing, secrets, substring_dedup, suffix_dedup, tokens, toxicity, warc
from tessera.llm.oracle import ORACLE

QUERIES = {
    "op1_ngram_join": ngram_join.op1,
    "op2_secret_scan": secrets.op2,
    "op3_suffix_dedup": suffix_dedup.op3,
    "op4_decontaminate": decontaminate.op4,
    "op5_cover_tree": cover_tree.op5,
    "op6_substring_dedup": substring_dedup.op6,
    "op7_token_counts": tokens.op7,
    "op8_warc": warc.op8,
    "op9_packing": packing.op9,
    "op10_toxicity": toxicity.op10,
}

__all__ = ["ORACLE", "QUERIES"]
