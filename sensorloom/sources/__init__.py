"""Readers, writers and the mapping of a star schema onto sensor tables."""
