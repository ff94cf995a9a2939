"""Operators for large text and vector corpora. Nothing outside this package imports it."""
