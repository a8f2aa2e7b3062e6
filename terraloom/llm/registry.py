"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib

#: Module, query.
OPERATORS = [
    ("topk", "op1_segment_topk"),
    ("substring_dedup", "op2_substring_dedup"),
    ("bpe", "op3_byte_bpe"),
    ("html", "op4_html_main_text"),
    ("pii", "op5_pii_bootstrap"),
    ("packing", "op6_best_fit_packing"),
    ("neardup", "op7_odd_sketch_neardup"),
    ("langid", "op8_rank_order_langid"),
    ("sharding", "op9_rendezvous_sharding"),
    ("quality", "op10_compression_bands"),
]


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"{__package__}.{module}"), name) for module, name in OPERATORS}


def oracle_sql() -> dict[str, str]:
    found = ((name, getattr(importlib.import_module(f"{__package__}.{module}"), "SQL", None)) for module, name in OPERATORS)
    return {name: sql for name, sql in found if sql}
