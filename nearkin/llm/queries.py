"""The contract queries of this package, and their SQL where there is any."""

from __future__ import annotations

from . import decontamination, differencing, packing, quality, simhash, substrings, token_files, topk, toxicity, warc

QUERIES = {
    "op1_substring_dedup": substrings.op1_substring_dedup,
    "op2_decontamination": decontamination.op2_decontamination,
    "op3_simhash": simhash.op3_simhash,
    "op4_page_text": differencing.op4_page_text,
    "op5_token_files": token_files.op5_token_files,
    "op6_packing": packing.op6_packing,
    "op7_warc": warc.op7_warc,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_quality": quality.op9_quality,
    "op10_top_k": topk.op10_top_k,
}

ORACLE_SQL: dict[str, str] = {"op1_substring_dedup": substrings.OP1_SQL, "op2_decontamination": decontamination.OP2_SQL, "op10_top_k": topk.OP10_SQL}
