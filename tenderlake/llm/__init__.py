"""Operators for preparing training text: one module per operator, plus the queries that apply them.

Nothing outside this sub-package (and ``corpus_pipeline.py`` at the repository top) imports it.
"""
