"""Relational operators over one table."""
