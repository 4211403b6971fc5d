"""Readers, writers and stored results."""
