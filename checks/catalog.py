"""Imports every check module so that its queries register themselves."""

from checks import combined, forecast, futures, market, observations, rules, signals, state, stores, weather  # noqa: F401
from checks.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
