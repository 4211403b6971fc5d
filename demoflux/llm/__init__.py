"""Operators that prepare training text, their queries and their checks."""
