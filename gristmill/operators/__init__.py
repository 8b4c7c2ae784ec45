"""Operators over DataFrames; each states how it treats nulls, ties and empty input."""
