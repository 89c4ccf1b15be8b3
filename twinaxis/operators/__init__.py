"""Operators over datoms; each takes and returns DataFrames."""
