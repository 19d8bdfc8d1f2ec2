"""All queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from .catalog_tables import ENTRIES as _TABLES
from .catalog_vectors import ENTRIES as _VECTORS

ENTRIES = _TABLES | _VECTORS


def queries():
    return {name: query for name, (query, _) in ENTRIES.items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in ENTRIES.items() if sql is not None}
