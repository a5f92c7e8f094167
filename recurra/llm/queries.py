"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from recurra.llm import bpe as op8
from recurra.llm import chat_format as op2
from recurra.llm import decontam as op4
from recurra.llm import lexical as op12
from recurra.llm import licenses as op3
from recurra.llm import merkle as op13
from recurra.llm import near_dup as op7
from recurra.llm import pii as op10
from recurra.llm import quality_model as op9
from recurra.llm import quality_rules as op5
from recurra.llm import toxicity as op6
from recurra.llm import warc as op1
from recurra.llm import word_bpe as op11

QUERIES = {
    "op1_warc_revisits": op1.op1_warc_revisits,
    "op2_chat_formatting": op2.op2_chat_formatting,
    "op3_license_scan": op3.op3_license_scan,
    "op4_benchmark_decontamination": op4.op4_benchmark_decontamination,
    "op5_quality_rules": op5.op5_quality_rules,
    "op5_quality_rules_short": op5.op5_quality_rules_short,
    "op7_minhash_near_dedup": op7.op7_minhash_near_dedup,
    "op8_byte_level_bpe": op8.op8_byte_level_bpe,
    "op6_toxicity": op6.op6_toxicity,
    "op9_quality_classifier": op9.op9_quality_classifier,
    "op10_pii": op10.op10_pii,
    "op11_word_bpe": op11.op11_word_bpe,
    "op12_lexical_search": op12.op12_lexical_search,
    "op13_merkle_manifest": op13.op13_merkle_manifest,
}

SQL: dict[str, str] = {
    "op1_warc_revisits": op1.SQL,
    "op2_chat_formatting": op2.SQL,
    "op4_benchmark_decontamination": op4.SQL,
    "op5_quality_rules": op5.SQL,
    "op7_minhash_near_dedup": op7.SQL,
    "op12_lexical_search": op12.SQL,
    "op13_merkle_manifest": op13.SQL,
}
