"""Column expressions and small distributed building blocks shared by the operators."""
