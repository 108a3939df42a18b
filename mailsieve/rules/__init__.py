"""Fixed values of the scoring rules, one module per layer."""
