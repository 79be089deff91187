"""Column functions: one definition for each scalar rule."""
