"""Column expressions, the grid, and refusals."""
