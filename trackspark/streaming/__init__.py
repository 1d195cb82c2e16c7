"""Structured Streaming versions of the per-track and per-task jobs."""
