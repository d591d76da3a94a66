"""sources of the cadenza engine."""
