"""Verdigraph: plans."""
