"""Artifact audit and corpus analytics on Spark DataFrames."""
