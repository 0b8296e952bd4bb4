"""Geocoding and spatial search over DataFrames of queries."""
