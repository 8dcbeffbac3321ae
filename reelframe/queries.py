"""All relational forms of the operators on the star-schema tables, and the SQL that checks them."""

from __future__ import annotations

from .plans import files, frames, hooks, live, measures, names, timelines
from .plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "files", "frames", "hooks", "live", "measures", "names", "timelines"]
