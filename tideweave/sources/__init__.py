"""sources of the ensemble engine."""
