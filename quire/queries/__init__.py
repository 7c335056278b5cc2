"""Queries over the example tables, one for each operator or small group of them."""

from quire.queries import builtin, engine, evaluation, files, outline, retrieval, trees  # noqa: F401
from quire.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
