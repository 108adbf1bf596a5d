"""Readers, writers and the tables derived from the benchmark data."""
