"""All registered queries of the engine and their SQL twins."""

from quarrylight.plans import storage  # noqa: F401  registers its queries
from quarrylight.plans.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
