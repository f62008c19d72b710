"""Readers and writers of statements and ledgers."""
