"""Readers and bindings."""
