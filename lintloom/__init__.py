"""Lintloom: a Spark-native engine for code-lint and instruction-tuning datasets."""
