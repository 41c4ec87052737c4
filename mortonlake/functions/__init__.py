"""Column functions: Morton codes, distances, validation."""
