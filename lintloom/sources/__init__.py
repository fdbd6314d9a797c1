"""Lintloom sources."""
