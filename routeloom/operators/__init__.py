"""Relational operators of the engine, as functions from DataFrames to DataFrames."""
