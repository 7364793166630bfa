"""The registered queries of the grid engine and their DuckDB SQL."""

from meshlark.plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
