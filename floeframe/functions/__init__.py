"""Column expressions and ordering primitives shared by the operators."""
