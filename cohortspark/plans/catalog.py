"""All registered queries; importing the modules fills the registry."""

from cohortspark.plans import basics, behaviour, lifehistory, lookup, sampling  # noqa: F401
from cohortspark.plans.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
