"""Readers and writers of receptor tables, assignments and reports."""
