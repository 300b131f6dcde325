"""Operators for large text and vector collections.  Nothing else in the library imports this."""
