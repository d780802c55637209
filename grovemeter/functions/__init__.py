"""Column expressions and their argument forms."""
