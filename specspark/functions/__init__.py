"""Column expressions and scalar numerics."""
