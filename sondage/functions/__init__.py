"""Column expressions and scalar reference distributions."""
