"""Watching a stream of entries for new ones."""
