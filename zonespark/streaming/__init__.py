"""Structured Streaming fronts of the operators that work record by record."""
