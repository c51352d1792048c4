"""Filters and calculations as columns."""
