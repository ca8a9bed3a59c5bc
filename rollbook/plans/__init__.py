"""The named queries and their SQL twins."""
