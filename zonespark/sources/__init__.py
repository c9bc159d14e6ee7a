"""Readers of zone, flow and adjacency data."""
