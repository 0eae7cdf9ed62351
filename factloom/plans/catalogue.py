"""All registered queries and their SQL."""

from factloom.plans import changes, dashboards, flow, inputs, models, operations, reviews, scoring, texts, vectors  # noqa: F401  they register themselves
from factloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
