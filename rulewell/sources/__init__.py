"""Scans, sinks and stored corpora."""
