"""Operators for preparing text corpora at scale; nothing else in the package imports this."""
