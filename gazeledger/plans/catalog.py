"""All registered queries."""

from gazeledger.plans import queries_access, queries_risk, queries_sources, queries_text  # noqa: F401
from gazeledger.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
