"""Column builders: scalar functions and ordered rules."""
