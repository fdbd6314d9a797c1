"""Lintloom streaming."""
