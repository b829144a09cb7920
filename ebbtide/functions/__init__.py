"""Column expressions without any Python on the row path."""
