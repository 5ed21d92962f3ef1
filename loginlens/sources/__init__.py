"""Readers, writers and document extraction."""
