"""Verdigraph: functions."""
