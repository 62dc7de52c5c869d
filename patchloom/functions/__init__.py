"""Column functions on text, paths and findings."""
