"""All queries of the core and their SQL."""

from . import corpus, events, metrics, relations, reports  # noqa: F401  (they register their queries)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
