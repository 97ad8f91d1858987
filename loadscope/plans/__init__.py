"""plans of the load-surface engine."""
