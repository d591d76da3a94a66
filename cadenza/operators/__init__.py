"""operators of the cadenza engine."""
