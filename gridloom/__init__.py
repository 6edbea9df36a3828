"""Mesh and graph partitioning on Spark DataFrames."""
