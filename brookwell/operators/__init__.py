"""Relational operators as functions of columns and DataFrames."""
