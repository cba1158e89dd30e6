"""Whole products built from operators."""
