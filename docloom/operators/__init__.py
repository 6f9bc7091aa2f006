"""Relational, graph and search operators on DataFrames."""
