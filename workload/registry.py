"""Imports every module that registers queries."""

from workload import names, planning, plans, quality, search, streams, timectx, travel  # noqa: F401
from workload.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
