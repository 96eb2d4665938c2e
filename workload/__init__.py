"""Registered queries: stand-in tables, one function and one SQL text per operator."""

from workload import scoring, series, tuning, files, learning, stumps  # noqa: F401
from workload.registry import ORACLE, QUERIES  # noqa: F401
