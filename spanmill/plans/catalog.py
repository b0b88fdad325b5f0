"""All queries of the engine's own operators."""

from spanmill.plans import corpus_queries, run_queries, score_queries, source_queries, text_queries  # noqa: F401
from spanmill.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
