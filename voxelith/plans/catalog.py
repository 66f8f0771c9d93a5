"""All queries of the voxel operators and their SQL."""

from __future__ import annotations

from . import edit_queries, file_queries, shape_queries  # noqa: F401  (each adds its queries)
from .queries import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
