"""Spatial functions on WKB columns."""
