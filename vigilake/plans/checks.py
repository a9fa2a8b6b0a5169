"""Imports every module of checks so that the registry is complete."""

from vigilake.plans import operator_checks, reach_checks, report_checks, signal_checks, source_checks  # noqa: F401
from vigilake.plans.registry import QUERIES, SQL  # noqa: F401
