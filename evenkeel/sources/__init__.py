"""Readers of keyed records and logs, generated keys, and sinks."""
