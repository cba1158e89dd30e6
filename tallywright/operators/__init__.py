"""Operators over the logical books."""
