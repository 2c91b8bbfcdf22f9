"""Queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from crosslane.llm import (
    bpe,
    chat,
    decontaminate,
    filter_audit,
    fingerprints,
    licenses,
    line_dedup,
    minhash,
    phrases,
    token_files,
    topk,
    toxicity,
    warc,
)

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_chat_format": chat.op2_chat_format,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_bpe": bpe.op6_bpe,
    "op7_token_files": token_files.op7_token_files,
    "op8_fingerprints": fingerprints.op8_fingerprints,
    "op9_near_duplicates": minhash.op9_near_duplicates,
    "op10_licenses": licenses.op10_licenses,
    "op11_phrases": phrases.op11_phrases,
    "op12_topk": topk.op12_topk,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}

ORACLE = {
    "op1_warc": warc.OP1_SQL,
    "op2_chat_format": chat.OP2_SQL,
    "op4_decontaminate": decontaminate.OP4_SQL,
    "op5_line_dedup": line_dedup.OP5_SQL,
    "op9_near_duplicates": minhash.OP9_SQL,
    "op11_phrases": phrases.OP11_SQL,
    "op12_topk": topk.OP12_SQL,
    "op13_filter_audit": filter_audit.OP13_SQL,
}
