"""Operators on training text, code and vectors; nothing outside this subpackage imports it."""
