"""Listings, logs and settings as DataFrames."""
