"""Structured Streaming forms of reconciliation and point-in-time visibility."""
