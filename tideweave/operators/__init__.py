"""operators of the ensemble engine."""
