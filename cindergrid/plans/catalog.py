"""Import every driver-query module so the registry is complete."""

from cindergrid.plans import (  # noqa: F401
    driver_composites,
    driver_fits, driver_linear,
    driver_models,
    driver_panel,
    driver_reports,
    driver_sketches,
    driver_stats,
)
from cindergrid.plans.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
