"""Terrace: build and prove warehouse models with PySpark DataFrames."""
