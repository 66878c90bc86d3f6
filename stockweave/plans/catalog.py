"""All registered planning queries and their SQL."""

from __future__ import annotations

from . import decisions, descents, intake, resources, structures  # noqa: F401  registers queries
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
