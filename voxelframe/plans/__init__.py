"""Query plans on the test tables, each with the SQL that checks it."""

from . import kernels, measures, points, slices, steps, structures  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
