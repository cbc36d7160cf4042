"""Verdigraph: operators."""
