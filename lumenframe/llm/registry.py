"""The registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from functools import wraps
from importlib import import_module

from lumenframe.llm.shared import ship

#: query name -> module of this subpackage that has a function of that name and maybe SQL.
MODULES = {
    "op1_language_id": "langid",
    "op2_html_text": "html_text",
    "op3_url_filter": "url_filter",
    "op4_toxicity": "toxicity",
    "op5_fingerprints": "imatch",
    "op6_bpe": "bpe",
    "op7_near_dedup": "near_dedup",
    "op8_sharding": "sharding",
    "op9_quality": "quality",
    "op10_decontamination": "decontaminate",
    "op11_chat_format": "chat",
    "op12_token_alignment": "align",
    "op13_vector_codes": "annular",
}


def shipped(query):
    """The query, once executors have this package."""

    @wraps(query)
    def run(spark, *args):
        ship(spark)
        return query(spark, *args)

    return run


def queries() -> dict:
    return {name: shipped(getattr(import_module(f"lumenframe.llm.{module}"), name)) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"lumenframe.llm.{module}"), "SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
