"""Relational operators over entries."""
