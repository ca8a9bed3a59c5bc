"""Operators over ledgers: filters, joins, statistics, series, repairs."""
