"""Exact and approximate analytics over one table, planned as Spark DataFrames."""
