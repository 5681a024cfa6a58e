"""Registered queries with their reference SQL over the given tables."""

from contract import generation_queries, operator_queries, run_queries, source_queries, text_queries  # noqa: F401
from contract.base import ORACLES, QUERIES  # noqa: F401
