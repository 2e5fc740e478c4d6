"""Scans, sinks and views of the shared test tables."""
