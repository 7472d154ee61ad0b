"""All registered queries."""

from bookloom.plans import catalogue, formats  # noqa: F401  they register their queries
from bookloom.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
