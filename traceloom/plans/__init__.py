"""Declarative queries, from a specification to a chain of DataFrames."""
