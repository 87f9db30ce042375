"""Inverse resampling and its analytics on Spark DataFrames."""
