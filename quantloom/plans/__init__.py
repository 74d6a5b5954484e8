"""Registered queries over the driver's tables, and their SQL for an independent engine."""

from quantloom.plans import evaluation_q, joins_q, models_q, more_q, panels_q, portfolio_q, quantiles_q, sources_q, stats_q, streams_q, windows_q  # noqa: F401
from quantloom.plans.base import ORACLE, QUERIES
from quantloom.plans.portfolio_q import flagship

__all__ = ["ORACLE", "QUERIES", "flagship"]
