"""Operators on ledgers: filters, joins, aggregates, series, models."""
