"""Twelve operators that prepare training data, each a function from DataFrames to DataFrames."""
