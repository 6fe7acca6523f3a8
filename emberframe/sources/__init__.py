"""Readers, writers and the canonical tables."""
