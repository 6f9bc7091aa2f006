"""Column expressions for text, paths, numbers and arrays."""
