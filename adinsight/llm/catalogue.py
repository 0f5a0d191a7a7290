"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from adinsight.llm import bpe, collocations, decontamination, html_text, jaccard_join, packing, pii, quality_rules, quotes, secrets, suffix_tree_lm, token_codes, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_directly_addressable_codes": token_codes.op1_directly_addressable_codes,
    "op2_rank_array_bpe": bpe.op2_rank_array_bpe,
    "op9_suffix_automaton": decontamination.op9_suffix_automaton,
    "op10_secret_scan": secrets.op10_secret_scan,
    "op6_ngram_ratio_rules": quality_rules.op6_ngram_ratio_rules,
    "op8_signature_tree_join": jaccard_join.op8_signature_tree_join,
    "op4_template_removal": html_text.op4_template_removal,
    "op5_suffix_tree_score": suffix_tree_lm.op5_suffix_tree_score,
    "op3_surrogates": pii.op3_surrogates,
    "pipeline": corpus_pipeline.run,
    "op7_quote_linking": quotes.op7_quote_linking,
    "op11_vector_best_fit": packing.op11_vector_best_fit,
    "op13_dynamic_itemset_counting": collocations.op13_dynamic_itemset_counting,
    "op12_embedding_whitening": whitening.op12_embedding_whitening,
}
ORACLES: dict[str, str] = {"op13_dynamic_itemset_counting": collocations.ORACLE}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
