"""All registered queries."""

from . import groups, profiles, texts, totals  # noqa: F401  (importing registers)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
