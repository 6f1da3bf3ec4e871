"""Spatial resource analytics on Spark DataFrames."""
