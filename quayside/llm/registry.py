"""The queries of this subpackage and, where SQL can state them, their DuckDB counterparts."""

from quayside.llm import decontam, langid, linededup, neardup, pii, piecewise, quality, tokenids, topk, warc

QUERIES = {
    "op1_exact_topk": topk.op1_exact_topk,
    "op2_token_ids": tokenids.op2_token_ids,
    "op3_decontamination": decontam.op3_decontamination,
    "op4_language_id": langid.op4_language_id,
    "op5_warc": warc.op5_warc,
    "op6_pii": pii.op6_pii,
    "op7_sentencepiece": piecewise.op7_sentencepiece,
    "op8_quality": quality.op8_quality,
    "op9_line_dedup": linededup.op9_line_dedup,
    "op10_near_duplicates": neardup.op10_near_duplicates,
}

SQL = {
    "op1_exact_topk": topk.OP1_SQL,
    "op5_warc": warc.OP5_SQL,
    "op10_near_duplicates": neardup.OP10_SQL,
}
