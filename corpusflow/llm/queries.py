"""All queries of this package: importing this module registers them."""

from __future__ import annotations

import importlib

from .common import QUERIES, SQL

MODULES = [
    "simhash", "extraction", "mixing", "compression_langid", "templates", "exact_dedup", "preferences", "toxicity", "ordinal_quality", "token_index",
    "fill_middle", "source_audit", "suffix_dedup",
]
for _module in MODULES:
    importlib.import_module(f"corpusflow.llm.{_module}")

__all__ = ["QUERIES", "SQL"]
