"""Operators over documents, pages, tokens and events: DataFrames in, DataFrames out, nothing collected."""
