"""Grouping strategies from end to end, and their comparison."""
