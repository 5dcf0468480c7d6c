"""All queries of the library."""

from __future__ import annotations

from . import (  # noqa: F401
    composite_queries,
    graph_queries,
    io_queries,
    join_queries,
    metric_queries,
    model_queries,
    raster_queries,
    registry,
    scalar_queries,
    table_queries,
    time_queries,
)

QUERIES, ORACLES = registry.QUERIES, registry.ORACLES
