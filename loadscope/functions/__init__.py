"""functions of the load-surface engine."""
