"""Composed plans: the cleaning chain, model training, sweeps, and the query catalog."""
