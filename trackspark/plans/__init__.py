"""Shared plan shapes: chunked scans, bucketed joins, nearest-site search, lineage cuts."""
