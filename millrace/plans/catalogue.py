"""All queries on the reference's own operators, with their SQL."""

from __future__ import annotations

from . import entities, finetune, metrics, pixels, retrieval, sources, text
from .registry import Query

MODULES = (text, retrieval, metrics, finetune, entities, pixels, sources)


def queries() -> dict[str, Query]:
    return {k: v for m in MODULES for k, v in m.R.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.R.sql.items()}
