"""Column expressions and scalar finishers."""
