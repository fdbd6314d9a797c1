"""Lintloom plans."""
