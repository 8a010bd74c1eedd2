"""Queries that apply the operators of this subpackage to their whole tables, and their SQL counterparts."""

from . import classifier, conversations, cws, langid, linededup, mixing, quality, sentencepieces, sharding, simhash, substrings, toxicity

QUERIES: dict = {
    "op1_mixing": mixing.op1_mixing,
    "op2_sentencepiece": sentencepieces.op2_sentencepiece,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_simhash": simhash.op4_simhash,
    "op5_quality_rules": quality.op5_quality_rules,
    "op6_line_dedup": linededup.op6_line_dedup,
    "op7_substring_dedup": substrings.op7_substring_dedup,
    "op8_language_id": langid.op8_language_id,
    "op9_quality_classifier": classifier.op9_quality_classifier,
    "op10_fingerprints": cws.op10_fingerprints,
    "op11_conversation_repair": conversations.op11_conversation_repair,
    "op12_sharding": sharding.op12_sharding,
}
ORACLES: dict = {
    "op1_mixing": mixing.OP1_SQL,
    "op5_quality_rules": quality.OP5_SQL,
    "op6_line_dedup": linededup.OP6_SQL,
    "op7_substring_dedup": substrings.OP7_SQL,
    "op8_language_id": langid.OP8_SQL,
    "op11_conversation_repair": conversations.OP11_SQL,
    "op12_sharding": sharding.OP12_SQL,
}
