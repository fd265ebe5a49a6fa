"""Column builders: text, vectors and time."""
