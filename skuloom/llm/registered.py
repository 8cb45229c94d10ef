"""Queries of this subpackage and their DuckDB statements, as ``__spark_entry__`` adds them."""

from __future__ import annotations

import corpus_pipeline
from skuloom.llm.oracle_sql import SQL
from skuloom.llm.queries import QUERIES


def queries() -> dict:
    return QUERIES | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return SQL | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
