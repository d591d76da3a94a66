"""plans of the cadenza engine."""
