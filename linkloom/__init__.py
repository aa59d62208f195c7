"""Temporal link prediction and what-if graph analytics as Spark jobs."""

__version__ = "0.1.0"
