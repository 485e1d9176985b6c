"""Every registered query of the library with its SQL."""

from .plans import catalog_queries, component_queries, job_queries, ledger_queries, metric_queries, pixel_queries, retrieval_queries, training_queries  # noqa: F401
from .plans.registry import ORACLES, QUERIES

FLAGSHIP = "I4"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
