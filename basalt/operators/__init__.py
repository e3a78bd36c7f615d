"""Operators that compose DataFrames: joins, frames, recursion, search, vectors, changes."""
