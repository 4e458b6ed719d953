"""Governed field extraction and its analytics as Spark DataFrames."""
