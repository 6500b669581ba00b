"""Queries of the corpus operators and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline

from . import chat, decontaminate, exact_dedup, html_main, langid, line_dedup, near_dedup, pieces, pii, token_files


def queries():
    return {
        "op1_sentencepiece": pieces.op1_sentencepiece,
        "op2_html_main": html_main.op2_html_main,
        "op3_pii": pii.op3_pii,
        "op4_near_dedup": near_dedup.op4_near_dedup,
        "op5_token_files": token_files.op5_token_files,
        "op6_decontaminate": decontaminate.op6_decontaminate,
        "op7_langid": langid.op7_langid,
        "op8_exact_dedup": exact_dedup.op8_exact_dedup,
        "op9_chat_format": chat.op9_chat_format,
        "op10_line_dedup": line_dedup.op10_line_dedup,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql():
    return {"op8_exact_dedup": exact_dedup.OP8_SQL, "op9_chat_format": chat.OP9_SQL, "op10_line_dedup": line_dedup.OP10_SQL}
