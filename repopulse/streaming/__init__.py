"""Incremental landing of result pages."""

from repopulse.streaming.landing import land_nodes, page_stream

__all__ = ["land_nodes", "page_stream"]
