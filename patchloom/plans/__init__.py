"""End-to-end jobs and the queries over the driver tables."""
