"""Operators on DataFrames: index, search, suggestions, recommendations, metrics, analytics, pages."""
