"""Relational and log operators on DataFrames."""
