"""Scalar and aggregate functions with an embedded SQL database's semantics."""
