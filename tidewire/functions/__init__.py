"""Column functions and special functions."""
