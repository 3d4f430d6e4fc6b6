"""Groupings of live streams, with Structured Streaming."""
