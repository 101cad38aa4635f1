"""Registered queries: each binds operators to the given tables and states its SQL equivalent."""

from panelgrid.plans import (  # noqa: F401
    calibration, concordance, coverage, external, graph, identity, ranking, relations, reshape, similarity, sources,
    stability, text,
)
from panelgrid.plans.registry import ORACLES, QUERIES  # noqa: F401
