"""Operators of a training-data pipeline; nothing else in the library imports this subpackage.

queries() and oracle_sql() import the operators' modules when called, so that the subpackage itself imports quickly.
"""

from importlib import import_module

#: Query name -> (module, name of the DuckDB statement or None).
QUERIES = {
    "op1_decontaminate": ("op1_decontaminate", "OP1_SQL"),
    "op2_sentencepiece": ("op2_sentencepiece", None),
    "op3_simhash_dedup": ("op3_simhash", None),
    "op4_substring_dedup": ("op4_substrings", None),
    "op5_url_filter": ("op5_urls", None),
    "op6_line_dedup": ("op6_lines", "OP6_SQL"),
    "op7_token_counts": ("op7_counts", None),
    "op8_language_id": ("op8_langid", None),
    "op9_token_bin": ("op9_tokenbin", None),
    "op10_quality_rules": ("op10_quality", None),
    "op11_resample": ("op11_resample", None),
    "op12_minhash_dedup": ("op12_minhash", "OP12_SQL"),
    "op13_search": ("op13_search", "OP13_SQL"),
}


def queries() -> dict:
    return {name: getattr(import_module(f".{module}", __name__), name) for name, (module, _) in QUERIES.items()}


def oracle_sql() -> dict:
    return {name: getattr(import_module(f".{module}", __name__), sql) for name, (module, sql) in QUERIES.items() if sql}
