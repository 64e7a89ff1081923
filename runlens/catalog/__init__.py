"""Named queries over the sample tables, each with its SQL counterpart."""

from runlens.catalog import care, errors, reads, reports, streams  # noqa: F401
from runlens.catalog.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
