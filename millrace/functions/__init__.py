"""Column expressions that add a named rule to a built-in function."""
