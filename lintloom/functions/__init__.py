"""Lintloom functions."""
