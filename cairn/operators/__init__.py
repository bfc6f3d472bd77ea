"""Operators of the block model on DataFrames."""
