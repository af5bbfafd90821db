"""Registered queries with the SQL that gives the same rows."""

from importlib import import_module

from pitlake.plans.registry import ORACLE_SQL, QUERIES

for _module in ("feature_queries", "quality_queries", "research_queries", "ledger_queries", "evaluate_queries", "security_queries", "source_queries", "stream_queries", "decision_queries", "regime_queries", "model_queries", "search_queries", "condition_queries", "walkforward_queries", "integrity_queries", "feed_queries"):
    import_module(f"pitlake.plans.{_module}")

__all__ = ["ORACLE_SQL", "QUERIES"]
