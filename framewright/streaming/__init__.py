"""Continuous ingestion of landed pages."""
