"""Operators for text corpora and large numeric columns; nothing else in the library imports this package."""
