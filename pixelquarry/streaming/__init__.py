"""Structured Streaming upkeep of the catalog."""
