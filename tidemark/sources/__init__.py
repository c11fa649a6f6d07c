"""Readers, extractors and writers of the tables."""
