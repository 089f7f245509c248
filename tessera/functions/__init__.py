"""Column functions: names and keys, vectors, numbers."""
