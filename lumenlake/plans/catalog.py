"""All registered queries."""

from __future__ import annotations

from . import queries_cells, queries_meta, queries_raster  # noqa: F401
from .registry import QUERIES, Query


def all_queries() -> dict[str, Query]:
    return QUERIES
