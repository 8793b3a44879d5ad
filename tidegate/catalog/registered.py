"""Importing this module fills the query catalog."""

from tidegate.catalog import changes, decisions, diffs, filters, graph, jobs, joins, metrics, retrieval, scalars, sets, sources, streams, windows  # noqa: F401
from tidegate.catalog.base import ENTRIES

__all__ = ["ENTRIES"]
