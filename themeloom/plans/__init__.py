"""Whole jobs (G1-G10) composed from the operators."""
