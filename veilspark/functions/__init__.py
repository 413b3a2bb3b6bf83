"""Column functions and scalar checks."""
