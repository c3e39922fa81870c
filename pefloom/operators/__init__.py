"""The operators on records, matrices, factors and results."""
