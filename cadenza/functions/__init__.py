"""functions of the cadenza engine."""
