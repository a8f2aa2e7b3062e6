"""Spatial, numeric and graph analytics on Spark DataFrames."""
