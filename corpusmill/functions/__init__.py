"""Column expressions and plain functions that the operators are made of."""
