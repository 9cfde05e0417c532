"""Audit, clean and prepare training data with Spark DataFrames."""
