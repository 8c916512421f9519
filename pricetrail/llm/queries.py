"""The training-data queries and their oracle SQL."""

from __future__ import annotations

from . import conversations, embedding_dedup, extraction, language, line_dedup, mixing, neighbours, packing, quality, simhash, toxicity, warc, whitening

QUERIES = {
    "op1_neighbours": neighbours.op1_neighbours,
    "op2_quality": quality.op2_quality,
    "op3_embedding_dedup": embedding_dedup.op3_embedding_dedup,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_simhash": simhash.op5_simhash,
    "op6_packing": packing.op6_packing,
    "op7_extraction": extraction.op7_extraction,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_language": language.op9_language,
    "op10_mixing": mixing.op10_mixing,
    "op11_conversations": conversations.op11_conversations,
    "op12_whitening": whitening.op12_whitening,
    "op13_warc": warc.op13_warc,
}

ORACLES: dict[str, str] = {
    "op10_mixing": mixing.OP10_SQL,
}
