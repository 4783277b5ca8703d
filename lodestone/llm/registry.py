"""Names of the operator queries and, where SQL can express them, their DuckDB equivalents."""

import importlib

MODULES = ("op1_quality", "op2_bpe", "op3_warc", "op4_substring", "op5_gif", "op6_tokens", "op7_language", "op8_simhash", "op9_html", "op10_mixing")


def _modules():
    return [importlib.import_module(f"lodestone.llm.{m}") for m in MODULES]


def queries():
    return {m.NAME: m.query for m in _modules()}


def oracle_sql():
    return {m.NAME: m.ORACLE_SQL for m in _modules() if getattr(m, "ORACLE_SQL", None)}
