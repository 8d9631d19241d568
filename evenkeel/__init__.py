"""Fairness-aware data preparation, auditing and experiment analysis on Spark tables."""

from evenkeel.roles import Roles

__all__ = ["Roles"]
