"""Ledger analytics as Spark jobs."""
