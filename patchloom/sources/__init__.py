"""Readers and parsers of raw inputs, and writers of result tables."""
