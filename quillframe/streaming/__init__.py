"""streaming of the statement engine."""
