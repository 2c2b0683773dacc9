"""The queries of this subpackage and, where SQL can say the same, their DuckDB text."""

from __future__ import annotations

from . import alignment, decontamination, line_rules, mixing, ngram_join, phrases, pieces, quality, sharding, sstable, suffix_dedup, token_counts, toxicity

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_decontamination": decontamination.op2_decontamination,
    "op3_ngram_join": ngram_join.op3_ngram_join,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_token_sstable": sstable.op5_token_sstable,
    "op6_sharding": sharding.op6_sharding,
    "op7_line_rules": line_rules.op7_line_rules,
    "op8_quality": quality.op8_quality,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_mixing": mixing.op10_mixing,
    "op11_token_alignment": alignment.op11_token_alignment,
    "op12_phrases": phrases.op12_phrases,
    "op13_sentencepiece": pieces.op13_sentencepiece,
}

#: The others have tokenizers, models, rings, tries or alignments in them; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {"op7_line_rules": line_rules.ORACLE_SQL, "op12_phrases": phrases.ORACLE_SQL}
