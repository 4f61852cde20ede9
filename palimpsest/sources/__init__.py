"""Readers: pattern files and test tables."""
