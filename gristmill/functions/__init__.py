"""Column functions and registered user functions."""
