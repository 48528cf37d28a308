"""Operators for large text corpora and sketches over huge columns; nothing outside this folder imports it."""
