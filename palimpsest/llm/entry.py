"""Queries and oracle SQL of this subpackage, as ``__spark_entry__`` registers them."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_templates, decontaminate, jaccard_join, language_id, line_dedup, phrase_mining, pivot_index, ranked_search, sentencepieces, suffix_dedup, surrogates, toxicity, zip_archives

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_sentencepiece": sentencepieces.op2_sentencepiece,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_jaccard_join": jaccard_join.op4_jaccard_join,
    "op5_language_id": language_id.op5_language_id,
    "op6_warc": zip_archives.op6_warc,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_surrogates": surrogates.op8_surrogates,
    "op9_embedding_neardup": pivot_index.op9_embedding_neardup,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_phrases": phrase_mining.op11_phrases,
    "op12_chat_format": chat_templates.op12_chat_format,
    "op13_ranked_search": ranked_search.op13_ranked_search,
}

ORACLES: dict[str, str] = {
    "op6_warc": zip_archives.ORACLE,
    "op7_decontaminate": decontaminate.ORACLE,
    "op10_line_dedup": line_dedup.ORACLE,
    "op11_phrases": phrase_mining.ORACLE,
    "op12_chat_format": chat_templates.ORACLE,
    "op13_ranked_search": ranked_search.ORACLE,
}
