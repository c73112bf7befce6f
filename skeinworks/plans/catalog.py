"""Registry of the core queries and their SQL check."""

from __future__ import annotations

from ..operators import references
from ..streaming import incremental
from . import file_queries, queries, sqltext

QUERIES = {"p6_found": references.p6_found, "p6_counts": references.p6_counts, **queries.QUERIES, **file_queries.QUERIES, **incremental.QUERIES}
SQL = {"p6_found": sqltext.P6_FOUND, "p6_counts": sqltext.P6_COUNTS, **queries.SQL, **file_queries.SQL, **incremental.SQL}
