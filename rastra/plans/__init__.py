"""The queries of the raster engine."""

from rastra.plans import model_queries, raster_queries, table_queries, tile_queries  # noqa: F401
from rastra.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
