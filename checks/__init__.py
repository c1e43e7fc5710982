"""Every operator as a query over the driver tables, next to the same query in plain SQL."""

from checks import (  # noqa: F401  (importing a module registers its queries)
    geometry,
    grading,
    labels,
    merge,
    models,
    policy,
    prep,
    profile,
    replay,
    signals,
    sources,
    streams,
    workflows,
)
from checks.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
