"""Registered queries: name, DataFrame function and the SQL it is checked against."""

from __future__ import annotations

from atrium.plans import annotation, contraction, coverage, drawing, greedy, network, overlays, placement, planner, raster, simulation, upkeep
from atrium.plans.query import Query

QUERIES: dict[str, Query] = {}
for module in (coverage, network, placement, simulation, annotation, raster, planner, greedy, upkeep, overlays, drawing, contraction):
    QUERIES |= module.QUERIES
