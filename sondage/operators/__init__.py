"""Operators by family; each is a function of DataFrames returning a DataFrame."""
