"""Incremental forms of the lifecycle and guard jobs."""
