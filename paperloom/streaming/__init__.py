"""Structured Streaming jobs and, next to each stateful one, its batch form over window functions."""
