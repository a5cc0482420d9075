"""Operators for training-data pipelines and their registered queries."""

from .queries import ORACLES, QUERIES  # noqa: F401
