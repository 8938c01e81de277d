"""All registered queries of the library's own operators."""

from . import catalog_queries, grid_queries, slot_queries, source_queries, timeline_queries  # noqa: F401  (they register)
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
