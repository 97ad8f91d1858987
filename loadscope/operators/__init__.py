"""operators of the load-surface engine."""
