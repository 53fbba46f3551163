"""Column-in, column-out expressions."""
