"""streaming of the cadenza engine."""
