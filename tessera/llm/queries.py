"""The queries of this subpackage and the SQL of those that SQL can express."""

from importlib import import_module

#: In the order of the operators.
MODULES = ("ann", "impact", "packing", "ngram_join", "toxicity", "secrets", "suffix_dedup", "html_text", "token_counts", "sentencepieces")

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _name in MODULES:
    _module = import_module(f"{__package__}.{_name}")
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= getattr(_module, "ORACLE_SQL", {})
