"""Training-data operators for language models.

Nothing outside this package imports it; the queries of the ten operators are in
``lintloom.llm.registry``.
"""
