"""Verdigraph: inference."""
