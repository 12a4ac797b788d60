"""Importing this registers every query of the library."""

from jobgrain.plans import ingest_queries, signal_queries, source_queries, view_queries  # noqa: F401
