"""Lintloom operators."""
