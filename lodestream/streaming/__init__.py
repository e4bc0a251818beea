"""Structured Streaming forms of upkeep and of working sets."""
