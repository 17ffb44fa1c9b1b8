"""All named queries and, where SQL expresses them, their SQL."""

from tradeflow.plans import ahead, alerts, catalog, feedside, flow, learning, live, panels, reports, sliding, statements, streams, text, tuning  # noqa: F401
from tradeflow.plans.named import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
