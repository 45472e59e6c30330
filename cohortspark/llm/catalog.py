"""All queries of this subpackage; importing the modules fills the registry."""

from cohortspark.llm import queries  # noqa: F401
from cohortspark.llm.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
