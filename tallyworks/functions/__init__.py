"""Column expressions and the distributed ordering helper shared by the operators."""
