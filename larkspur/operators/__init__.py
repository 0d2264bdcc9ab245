"""Operators over DataFrames of lines, matches and findings."""
