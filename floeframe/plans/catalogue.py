"""Imports every subject module, so that the registry is complete."""

from . import cost, drift, exposure, forecast, missions, models, planned, risk, routes, storage, tracks  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
