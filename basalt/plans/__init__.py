"""Registered queries, by family."""
