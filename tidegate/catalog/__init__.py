"""Named queries over the warehouse tables, each with a SQL twin where one exists."""

from tidegate.catalog.base import ENTRIES, Entry, query

__all__ = ["ENTRIES", "Entry", "query"]
