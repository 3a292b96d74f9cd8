"""Operators for building training data from large corpora of text."""
