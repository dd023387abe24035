"""All registered queries."""

from roundsman.plans import journeys, labelling, places, roads, scalars, tables, touring  # noqa: F401
from roundsman.plans.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
