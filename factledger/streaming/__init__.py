"""Streams over a ledger."""
