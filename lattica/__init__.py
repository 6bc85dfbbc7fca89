"""Lattica: panel analytics on Spark DataFrames."""
