"""All registered queries of the library."""

from lectio.plans import layouts, lines, linked, positions, records, relational, streams, texts, web  # noqa: F401
from lectio.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
