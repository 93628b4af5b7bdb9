"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

import corpus_pipeline
from docloom.llm import chat, decontaminate, html_text, jaccard_join, line_dedup, packing, pii, quality, secrets, substring_dedup

MODULES = (secrets, html_text, substring_dedup, quality, decontaminate, jaccard_join, pii, chat, line_dedup, packing)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in getattr(m, "ORACLE", {}).items()}
