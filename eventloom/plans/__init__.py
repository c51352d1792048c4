"""Queries: their specification and the DataFrames that answer them."""
