"""Queries over whole tables, each with its SQL counterpart."""
