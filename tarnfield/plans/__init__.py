"""Adapters from the driver's tables and the named queries built on them."""

from tarnfield.plans import compare_queries, cube_queries, flow_queries, lattice_queries, monitor_queries, rain_queries, vector_queries  # noqa: F401
from tarnfield.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
