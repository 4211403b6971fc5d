"""All registered queries."""

from demoflux.plans import census, geography, growth, inference, ingest, migration, population  # noqa: F401
from demoflux.plans.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
