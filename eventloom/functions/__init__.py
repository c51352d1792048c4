"""Columns for typed paths, durations and times."""
