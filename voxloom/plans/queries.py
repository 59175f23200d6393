"""All queries of the library but those for training text, and their DuckDB SQL."""

from __future__ import annotations

from . import cell_queries, seed_queries, shape_queries, table_queries

_ALL = {**cell_queries.QUERIES, **shape_queries.QUERIES, **table_queries.QUERIES, **seed_queries.QUERIES}


def queries():
    return {name: query for name, (query, _) in _ALL.items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
