"""Relational operators: diffs, joins, retrieval, verdicts, prompts and bookkeeping."""
