"""Column functions; no Python worker unless the docstring says so."""
