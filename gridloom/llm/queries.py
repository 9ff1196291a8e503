"""The queries of this subpackage, by name."""

from gridloom.llm import chat, exact_dedup, langid, line_dedup, lm_score, packing, periodic, pieces, quality, search, sharding, simhash, warc

MODULES = {
    "op1_sentencepiece": pieces,
    "op2_sharding": sharding,
    "op3_quality": quality,
    "op4_lm_score": lm_score,
    "op5_line_dedup": line_dedup,
    "op6_language_id": langid,
    "op7_simhash": simhash,
    "op8_exact_dedup": exact_dedup,
    "op9_warc": warc,
    "op10_packing": packing,
    "op11_chat_format": chat,
    "op12_ranked_search": search,
    "op13_periodic_runs": periodic,
}

QUERIES = {name: module.query for name, module in MODULES.items()}
#: Only SQL that gives all columns of its query.
ORACLES = {name: module.SQL for name, module in MODULES.items() if module.SQL}
