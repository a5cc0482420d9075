"""Registered queries.  Importing a query module registers its entries."""

from . import contract_queries, join_queries, regression_queries, pair_queries, sampling_queries, pixel_queries, study_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
