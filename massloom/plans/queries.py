"""All queries of the engine's own operators."""

from massloom.plans import queries_chemistry, queries_imaging, queries_relational, queries_scoring  # noqa: F401
from massloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
