"""Sources, the corpus store and model providers."""
