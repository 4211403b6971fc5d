"""Column expressions: semantics helpers, recodes, text and distribution functions."""
