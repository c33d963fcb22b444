"""Cartoloom: geographic extracts and encyclopedia dumps as Spark DataFrames."""
