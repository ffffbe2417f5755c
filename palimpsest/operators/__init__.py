"""Relational operators over the multi-version log."""
