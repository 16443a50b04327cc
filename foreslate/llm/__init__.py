"""Operators for preparing language-model training data, one module per operator."""

from importlib import import_module

#: Modules that register queries; each has QUERIES and, where SQL can express it, ORACLE_SQL.
MODULES = (
    "decontaminate", "bpe", "secrets", "token_files", "language_id", "chat_format", "exact_dedup", "jaccard_join",
    "suffix_dedup", "recurrent_lm", "orchard_clusters", "conversation_repair", "pattern_packing",
)


def catalog() -> tuple[dict, dict]:
    """Queries by name and their SQL twins."""
    queries, oracle = {}, {}
    for name in MODULES:
        module = import_module(f"{__name__}.{name}")
        queries |= module.QUERIES
        oracle |= getattr(module, "ORACLE_SQL", {})
    return queries, oracle
