"""Queries and SQL of the training-data operators, for __spark_entry__.py."""

from __future__ import annotations

from cartoloom.llm.fm import op10_factorisation_machine
from cartoloom.llm.huffman import op6_huffman_token_ids
from cartoloom.llm.media import op1_media_chunks
from cartoloom.llm.mixing import op5_mix_sources
from cartoloom.llm.ngram_lm import STUPID_BACKOFF_SQL, op3_stupid_backoff
from cartoloom.llm.packing import op2_best_fit_packing
from cartoloom.llm.pii import op8_pii
from cartoloom.llm.quality import op7_quality_rules
from cartoloom.llm.simhash import op9_simhash_near_dedup
from cartoloom.llm.toxicity import op4_toxicity

QUERIES = {f.__name__: f for f in (op1_media_chunks, op2_best_fit_packing, op3_stupid_backoff, op4_toxicity, op5_mix_sources, op6_huffman_token_ids, op7_quality_rules, op8_pii, op9_simhash_near_dedup, op10_factorisation_machine)}
#: The fitted models, the knapsack, the packing and the fingerprints have no SQL; tests compare with brute force.
ORACLE_SQL: dict[str, str] = {"op3_stupid_backoff": STUPID_BACKOFF_SQL}
