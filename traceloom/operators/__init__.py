"""Operators over allele frames; each takes and returns DataFrames."""
