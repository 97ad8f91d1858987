"""sources of the load-surface engine."""
