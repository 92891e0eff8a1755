"""Grouped association analytics and table operators on Spark DataFrames."""
