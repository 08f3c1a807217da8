"""Queries over the driver's tables with their SQL; importing the package registers those of all its modules."""

from voltaloom.plans import plot_queries, queries, session_queries, stream_queries

__all__ = ["plot_queries", "queries", "session_queries", "stream_queries"]
