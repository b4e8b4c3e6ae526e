"""Readers and writers with declared schemas and empty-result guards."""
