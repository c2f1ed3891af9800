"""Scans, sinks and the archive ingest."""
