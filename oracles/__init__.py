"""DuckDB SQL that answers the registered queries, written independently of them."""

from .build import oracle_sql

__all__ = ["oracle_sql"]
