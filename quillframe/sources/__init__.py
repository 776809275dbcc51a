"""sources of the statement engine."""
