"""plans of the ensemble engine."""
