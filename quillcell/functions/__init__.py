"""Column expressions and vectorised distribution functions."""
