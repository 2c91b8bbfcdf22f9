"""All registered queries."""

from crosslane.plans import (  # noqa: F401
    queries_evaluation,
    queries_features,
    queries_models,
    queries_sources,
    queries_tabular,
)
from crosslane.plans.catalog import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
