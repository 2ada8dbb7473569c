"""Operators for building training data: deduplication, filtering, mixing, tokenizing, scoring.

Nothing else in the library imports this subpackage.
"""
