"""All queries over the driver's tables; importing a module registers its queries."""

from . import relational, series, tracking
from .registry import QUERIES, SQL, query, table

__all__ = ["QUERIES", "SQL", "query", "relational", "series", "table", "tracking"]
