"""streaming of the load-surface engine."""
