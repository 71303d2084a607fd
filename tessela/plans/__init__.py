"""Queries, costs, plans and their lowering to DataFrames."""
