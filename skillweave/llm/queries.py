"""The queries of this subpackage and the SQL that states their results."""

from __future__ import annotations

from . import chat, decontaminate, exactdedup, langid, merkle, mixing, negatives, ngramjoin, ppm, qualityrules, tokenbin, toxicity, warc

QUERIES = {
    "op1_token_ids": tokenbin.op1_token_ids,
    "op2_warc": warc.op2_warc,
    "op3_language_id": langid.op3_language_id,
    "op4_chat_collapse": chat.op4_chat_collapse,
    "op5_decontamination": decontaminate.op5_decontamination,
    "op6_mixing": mixing.op6_mixing,
    "op7_ngram_jaccard": ngramjoin.op7_ngram_jaccard,
    "op8_exact_dedup": exactdedup.op8_exact_dedup,
    "op9_lm_score": ppm.op9_lm_score,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_quality_rules": qualityrules.op11_quality_rules,
    "op12_merkle_manifest": merkle.op12_merkle_manifest,
    "op13_hard_negatives": negatives.op13_hard_negatives,
}

ORACLE_SQL = {
    "op2_warc": warc.OP2_SQL,
    "op4_chat_collapse": chat.OP4_SQL,
    "op5_decontamination": decontaminate.OP5_SQL,
    "op8_exact_dedup": exactdedup.OP8_SQL,
    "op11_quality_rules": qualityrules.OP11_SQL,
    "op12_merkle_manifest": merkle.OP12_SQL,
    "op13_hard_negatives": negatives.OP13_SQL,
}
