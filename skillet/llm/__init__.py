"""Operators on training data: labels, samples, rankings, mappings, packing, leakage and subjects."""
