"""Column expressions and name helpers shared by the operators."""
