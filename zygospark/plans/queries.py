"""All registered queries."""

from zygospark.plans import answers, parsing, sites, stored, summaries, tables  # noqa: F401
from zygospark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
