"""Receptor tables that arrive over time."""
