"""All bound queries and their SQL."""

from archspark.plans import details, more, resolution, streams
from archspark.plans.bindings import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "details", "more", "resolution", "streams"]
