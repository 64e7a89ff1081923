"""Readers, writers and the adapter over the sample tables."""
