"""Readers producing canonical DataFrames."""
