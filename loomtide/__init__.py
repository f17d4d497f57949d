"""Ordered signal and event analytics on Spark DataFrames."""
