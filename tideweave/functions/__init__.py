"""functions of the ensemble engine."""
