"""Change-governance analytics expressed as Spark DataFrame jobs."""

__all__ = ["functions", "operators", "plans", "sources", "streaming"]
