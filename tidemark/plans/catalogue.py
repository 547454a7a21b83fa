"""All queries on change-history tables."""

from tidemark.plans import columns, diffs, joint, ordered, relational  # noqa: F401  (they register their queries)
from tidemark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
