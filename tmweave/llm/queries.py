"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from tmweave.llm import (
    byte_bpe, collocations, decontam, hard_negatives, mixing, near_dup, page_text, quality, secret_scan,
    tokens, urls, vectors_dup, warc,
)

QUERIES = {f.__name__: f for f in (
    warc.op1_warc_archives, urls.op2_url_reputation, decontam.op3_decontamination,
    near_dup.op4_near_duplicates, quality.op5_quality, tokens.op6_token_counts,
    vectors_dup.op7_embedding_duplicates, secret_scan.op8_secret_scan, mixing.op9_mix_sources,
    page_text.op10_html_text, collocations.op11_phrase_collocations,
    hard_negatives.op12_hard_negatives, byte_bpe.op13_byte_bpe)}

# The others are tested against brute force, a library's result or held-out labels.
ORACLE_SQL = {
    "op1_warc_archives": warc.OP1_SQL, "op2_url_reputation": urls.OP2_SQL,
    "op3_decontamination": decontam.OP3_SQL, "op4_near_duplicates": near_dup.OP4_SQL,
    "op7_embedding_duplicates": vectors_dup.OP7_SQL, "op9_mix_sources": mixing.OP9_SQL,
    "op11_phrase_collocations": collocations.OP11_SQL, "op12_hard_negatives": hard_negatives.OP12_SQL}
