"""Readers, writers and the binding of the catalog's concepts to tables."""
