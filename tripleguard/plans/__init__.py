"""Rankings, metrics and experiment tables."""
