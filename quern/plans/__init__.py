"""Work planning: slices, request batches, budgets."""
