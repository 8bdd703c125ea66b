"""Readers: documents of every supported kind to feeds and entries."""
