"""streaming of the ensemble engine."""
