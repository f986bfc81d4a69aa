"""Readers, writers and the fixed schemas of the tables."""
