"""The queries of this subpackage: name -> builder, and their DuckDB twins where SQL can say it."""

from __future__ import annotations

import importlib

_MODULES = ("op1_quality", "op2_chat", "op3_bpe", "op4_jaccard", "op5_embeddings", "op6_tokens",
            "op7_decontaminate", "op8_suffixes", "op9_sharding", "op10_licenses", "op11_merkle",
            "op12_divergence", "op13_imatch")


def _loaded():
    return {m: importlib.import_module(f"{__package__}.{m}") for m in _MODULES}


def queries():
    import corpus_pipeline
    return {m: getattr(mod, m) for m, mod in _loaded().items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql():
    return {m: mod.ORACLE_SQL for m, mod in _loaded().items() if getattr(mod, "ORACLE_SQL", None)}
