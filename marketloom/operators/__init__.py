"""Relational operators as functions of DataFrames."""
