"""Operators for preparing training data from a text corpus."""
