"""Queries of this package, one per operator, and SQL for those that SQL can express."""
from verstore.llm import embedding_dedup, exact_dedup, langid, minhash, mixing, packing, suffix_dedup, token_counts, toxicity, url_filter

MODULES = {
    "op1_exact_dedup": exact_dedup,
    "op2_minhash_near_dedup": minhash,
    "op3_source_mixing": mixing,
    "op4_suffix_array_dedup": suffix_dedup,
    "op5_toxicity": toxicity,
    "op6_url_filter": url_filter,
    "op7_language_id": langid,
    "op8_token_counts": token_counts,
    "op9_embedding_near_dedup": embedding_dedup,
    "op10_packing": packing,
}


def queries():
    return {name: module.query for name, module in MODULES.items()}


def oracle_sql():
    return {name: module.SQL for name, module in MODULES.items() if module.SQL}
