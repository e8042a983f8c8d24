"""Operators for large-scale training-data work. Nothing outside this folder imports it."""
