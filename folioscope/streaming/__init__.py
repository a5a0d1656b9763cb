"""Structured Streaming entry points of operators that also run in batch."""
