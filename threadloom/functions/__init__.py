"""Column functions and Arrow user-defined functions."""
