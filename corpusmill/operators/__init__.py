"""Operators over DataFrames; none of them collects data that grows with its input."""
