"""Column expressions. Nothing here looks at more than one row."""
