"""Topological and statistical analytics on Spark DataFrames."""
