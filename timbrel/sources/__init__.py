"""Scans, sinks and the views derived from the given tables."""
