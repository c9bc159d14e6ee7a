"""Operators for training data: quantile sketches, hidden duplicates, packing, mixing, residue."""
