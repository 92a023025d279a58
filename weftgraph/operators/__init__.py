"""Operators of the document graph: DataFrames or columns in, DataFrames or columns out."""
