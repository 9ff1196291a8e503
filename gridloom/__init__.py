"""Gridded, multi-source time series as Spark DataFrames."""
