"""Queries over the driver tables, with their DuckDB counterparts."""
