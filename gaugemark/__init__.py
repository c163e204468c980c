"""Forecast verification analytics on Spark DataFrames."""
