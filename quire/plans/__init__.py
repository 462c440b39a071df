"""Stand-in frames, the registered queries, and the composed case-study flows."""

from quire.plans.catalog import oracle_sql, queries

__all__ = ["queries", "oracle_sql"]
