"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from contextloom.llm import decontam, jaccard, langid, lm, mincut, mixing, quality, substrings, toxicity, warc
from contextloom.llm.sql import SQL as SQL

QUERIES = {
    "op1_quality_divergence": quality.op1_quality,
    "op2_warc_derivatives": warc.op2_derivatives,
    "op3_substring_factors": substrings.op3_substrings,
    "op4_mix_systematic": mixing.op4_mix,
    "op5_mincut_text": mincut.op5_main_text,
    "op6_ngram_jaccard": jaccard.op6_jaccard,
    "op7_decontaminate": decontam.op7_decontaminate,
    "op8_language_ftrl": langid.op8_language,
    "op9_toxicity_crf": toxicity.op9_toxicity,
    "op10_lattice_lm": lm.op10_lattice,
}

