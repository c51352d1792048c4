"""Ingestion as a stream."""
