"""Verdigraph: streaming."""
