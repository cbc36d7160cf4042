"""Verdigraph: sources."""
