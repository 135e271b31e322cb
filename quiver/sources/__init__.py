"""Readers and writers of vector files."""
