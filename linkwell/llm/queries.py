"""All queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from . import (
    op01_toxicity,
    op02_decontaminate,
    op03_quality,
    op04_secrets,
    op05_near_vectors,
    op06_pii,
    op07_jaccard,
    op08_html,
    op09_packing,
    op10_langid,
)

_MODULES = (op01_toxicity, op02_decontaminate, op03_quality, op04_secrets, op05_near_vectors, op06_pii, op07_jaccard, op08_html, op09_packing, op10_langid)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in _MODULES for name, sql in getattr(module, "ORACLE_SQL", {}).items()}
