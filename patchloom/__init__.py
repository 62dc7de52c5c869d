"""Spark jobs for code-review data: indexing, retrieval, verification and reporting over all repositories at once."""
