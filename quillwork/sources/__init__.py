"""Schemas, and the mapping of the given tables to the logical relations."""
