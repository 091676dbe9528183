"""Registered queries of the operators: name -> (query, SQL check or None)."""

from __future__ import annotations

from scholarmesh.llm import byte_encoding, chat_format, collocations, fill_middle, fingerprints, jaccard_join, near_dedup, packing
from scholarmesh.llm import quality_rules, secret_scans, suffix_dedup, token_files, toxicity

ENTRIES = {
    "op1_secret_scans": (secret_scans.op1_secret_scans, None),
    "op2_suffix_dedup": (suffix_dedup.op2_suffix_dedup, None),
    "op3_chat_format": (chat_format.op3_chat_format, chat_format.OP3_SQL),
    "op4_quality_rules": (quality_rules.op4_quality_rules, None),
    "op5_toxicity": (toxicity.op5_toxicity, None),
    "op6_token_files": (token_files.op6_token_files, None),
    "op7_near_dedup": (near_dedup.op7_near_dedup, None),
    "op8_byte_encoding": (byte_encoding.op8_byte_encoding, None),
    "op9_fingerprints": (fingerprints.op9_fingerprints, None),
    "op10_packing": (packing.op10_packing, None),
    "op11_collocations": (collocations.op11_collocations, None),
    "op12_jaccard_join": (jaccard_join.op12_jaccard_join, None),
    "op13_fill_middle": (fill_middle.op13_fill_middle, fill_middle.OP13_SQL),
}
