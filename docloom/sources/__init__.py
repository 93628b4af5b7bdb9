"""Scans, sinks and remote services."""
