"""Conditional, categorical and top-N aggregates as native SQL expressions."""

from .registry import NAMES, WINDOW_AGGREGATES, expression, feature

__all__ = ["NAMES", "WINDOW_AGGREGATES", "expression", "feature"]
