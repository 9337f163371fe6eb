"""The training-data queries by name, and their SQL where SQL can express them."""

from __future__ import annotations

from quern.llm import chat, decontaminate, jaccard, langid, lines, mixing, secrets, suffixes, syncmers, toxicity
from quern.llm.common import ship


def _shipped(query):
    def run(spark, sf_dir):
        ship(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict:
    found = {"op1_suffix_array_dedup": suffixes.op1_suffix_array_dedup, "op2_benchmark_decontamination": decontaminate.op2_benchmark_decontamination, "op3_line_dedup": lines.op3_line_dedup, "op4_document_fingerprints": syncmers.op4_document_fingerprints, "op5_chat_formatting": chat.op5_chat_formatting,
        "op6_language_id": langid.op6_language_id, "op7_toxicity": toxicity.op7_toxicity, "op8_ngram_jaccard_join": jaccard.op8_ngram_jaccard_join, "op9_mixing": mixing.op9_mixing, "op10_secret_scan": secrets.op10_secret_scan}
    return {name: _shipped(q) for name, q in found.items()}


def oracle_sql() -> dict[str, str]:
    return {"op2_benchmark_decontamination": decontaminate.ORACLE, "op3_line_dedup": lines.ORACLE, "op5_chat_formatting": chat.ORACLE, "op8_ngram_jaccard_join": jaccard.ORACLE}
