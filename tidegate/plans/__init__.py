"""Derived views over the warehouse tables and end-to-end jobs."""
