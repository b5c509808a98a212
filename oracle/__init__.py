"""DuckDB oracle: the same adapter and the *literal* report SQL (full dense grid,
then aggregate), written independently of the Spark plans it checks."""

from oracle.duckdb_sql import build_sql, oracle_queries

__all__ = ["build_sql", "oracle_queries"]
