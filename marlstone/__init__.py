"""Causal time-series research on Spark DataFrames."""
