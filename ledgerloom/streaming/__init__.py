"""Structured Streaming forms of ledger ingestion and daily spend."""
