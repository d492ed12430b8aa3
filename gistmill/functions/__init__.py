"""Column expressions and regular expressions."""
