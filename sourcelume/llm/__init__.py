"""Operators for preparing text and code collections; nothing else in the library imports this package."""
